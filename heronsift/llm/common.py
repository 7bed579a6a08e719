"""What the operators of this subpackage share: written tables and expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six white-space characters that the contracts name, as a regex class body.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting: it gets a temporary folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="heronsift-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/heronsift/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Lineage ends there: a lost executor costs no recomputation of what went before.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to Python at once.
BATCH_BYTES = 8 << 20


def batched_by_bytes(df: DataFrame) -> DataFrame:
    """``df``, whose session sends rows to Python in batches of ``BATCH_BYTES``, unless it has a bound of its own.

    Spark's bound is 64 MB and 10,000 rows, which executor and worker both hold;
    it is read when a plan starts, so the session keeps the setting.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or a variant of it that no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    name = want
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than the six white-space ones; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def crc32_bucket(col: Column, buckets: int) -> Column:
    """crc32 of the value as text, modulo ``buckets``; null stays null."""
    return F.crc32(col.cast("string")) % buckets


def sample_by_hash(df: DataFrame, key: str, rows: int, seed: str = "") -> DataFrame:
    """``rows`` rows at most, those with the smallest hash of ``key``.

    A count fixes a share of the hash range first, so that a task sends on
    little more than its part of the sample, whatever the table's size.
    """
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    total = df.count()
    share = min(1.0, 1.2 * rows / total + 40 / total) if total else 1.0
    return df.filter(h < int(share * (1 << 40)) + 1).orderBy(h, F.col(key)).limit(rows)


def keep_rows(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``hs_k_id`` and ``hs_k_loc``, one of those that repeat.

    Join and window are dealt by the same three columns, so rows are shuffled once.
    """
    own = [free_name(docs, f"hs_key{k}") for k in range(3)]
    n = free_name(docs, "hs_rank")
    key = lambda i, loc: (F.coalesce(i, F.lit(0)), i.isNull(), loc)
    marked = docs.withColumns(dict(zip(own, key(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))))
    named = keep.select(*(c.alias(x) for c, x in zip(key(F.col("hs_k_id"), F.col("hs_k_loc")), own)))
    one = Window.partitionBy(*own).orderBy(F.lit(1))
    return marked.join(named, own, "left_semi").withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
