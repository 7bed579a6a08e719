"""Exact deduplication by a streaming query with keyed state on disk.

Arrivals are a compact table: digest of the normalised text, stable identifier,
length, and a content locator (64-bit hash of the whole original text).  A
Structured Streaming query keeps one state row per digest in RocksDB, without
expiry: the identifier and locator of the row that stays, and the group's size.
Run again with the same state folder it continues, so later arrivals meet all
earlier ones.

A digest seen more than once is a hit, and hits are checked on full bytes: the
smallest and the largest normalised text of a hit's rows must be the same.
Both are partial aggregates, so a huge group sends one row per task.  Texts of
unlike content under one digest are told apart and grouped by their content.

Defined cases: null text counts as empty; null ids come after all others;
of rows alike in length and id the first arrival stays, exactly one per group;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, keep_rows, new_path, written

#: Hits reach the byte check through this many hash buckets, whatever their number.
HIT_BUCKETS = 1 << 20

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else every small store takes megabytes of disk ahead of its log.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without the six white-space characters; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """What the state keeps of each row.  ``digest_bits`` under 256 is for tests."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("sha256"),
        F.char_length(text).alias("n_points"),
        F.xxhash64(text).alias("locator"),
        F.monotonically_increasing_id().alias("arrival"),
    ).withColumn("digest", F.substring("sha256", 1, digest_bits // 4))


def _stays() -> Column:
    """Ordered so that the largest struct is the row that stays."""
    return F.struct(
        "n_points",
        F.col("doc_id").isNotNull().alias("has_id"),
        F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(0))).alias("id_down"),
        F.bitwise_not("arrival").alias("arrival_down"),
        "locator",
    )


def absorb(spark: SparkSession, table: str, schema, state: str) -> DataFrame:
    """Take the files under ``table`` into the keyed state; all keys that changed.

    ``state`` is a folder shared by all executors; a second call with more files
    in ``table`` reads only these and updates the same state.
    """
    out = f"{state}/changes"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        (
            spark.readStream.schema(schema).parquet(table)
            .groupBy("digest").agg(F.max(_stays()).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
            .writeStream.outputMode("update").foreachBatch(put)
            .option("checkpointLocation", f"{state}/query")
            .trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    kept = "digest string, keeper struct<n_points:int,has_id:boolean,id_down:bigint,arrival_down:bigint,locator:bigint>, group_size long"
    spark.createDataFrame([], kept).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch=-1")
    changes = spark.read.schema(kept + ", batch int").parquet(out)
    latest = F.max(F.struct("batch", "keeper", "group_size"))
    return changes.groupBy("digest").agg(latest.alias("x")).select("digest", "x.keeper", "x.group_size")


def collisions(docs: DataFrame, state: DataFrame, text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """Digests whose rows do not all hold the same normalised bytes.

    Only rows whose digest falls into a hit's bucket are compared.  The buckets
    number ``HIT_BUCKETS`` at most, so they can be broadcast at any size.
    """
    bucket = F.pmod(F.xxhash64("digest"), F.lit(HIT_BUCKETS)).cast("int")
    hits = state.filter("group_size > 1").select(bucket.alias("bucket")).distinct()
    plain = normalised(F.col(text_col))
    rows = docs.select(plain.alias("plain")).withColumn("digest", F.substring(F.sha2("plain", 256), 1, digest_bits // 4)).withColumn("bucket", bucket)
    suspects = rows.join(F.broadcast(hits), "bucket", "left_semi")
    return suspects.groupBy("digest").agg(F.min("plain").alias("least"), F.max("plain").alias("most")).filter("least <> most").select("digest")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, locator``."""
    spark = docs.sparkSession
    path = new_path(spark, "arrivals")
    arrivals(docs, id_col, text_col, digest_bits).write.parquet(path)
    seen = spark.read.parquet(path)
    state = written(absorb(spark, path, seen.schema, new_path(spark, "dedup-state")), "dedup-groups")
    unlike = written(collisions(docs, state, text_col, digest_bits), "dedup-unlike")
    if not unlike.isEmpty():  # group the colliding digests' rows by content
        state = state.join(unlike, "digest", "left_anti")
        told = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("plain"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("locator"))
        told = told.withColumn("digest", F.substring(F.sha2("plain", 256), 1, digest_bits // 4)).join(unlike, "digest", "left_semi").select("digest", "locator", "plain").distinct()
        own = seen.join(told, ["digest", "locator"])
        parts = own.groupBy("digest", "plain").agg(F.max(_stays()).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        apart = own.join(parts, ["digest", "plain"]).select(seen.columns + ["keeper", "group_size"])
        joined = seen.join(state, "digest").select(seen.columns + ["keeper", "group_size"]).unionByName(apart)
    else:
        joined = seen.join(state, "digest")
    keep_id = F.when(F.col("keeper.has_id"), F.bitwise_not("keeper.id_down"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        "group_size",
        (F.bitwise_not("keeper.arrival_down") == F.col("arrival")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        "locator",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keep = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("hs_k_id"), F.col("locator").alias("hs_k_loc")).distinct()
    return keep_rows(docs, keep, id_col, text_col)
