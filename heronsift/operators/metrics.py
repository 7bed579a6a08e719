"""Retrieval metrics over judged result lists.

A judgement row has ``qid, question, difficulty, mode, rank, doc, relevance, gold``.
All per-query metrics come from one exchange on (qid, difficulty, mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["qid", "difficulty", "mode"]
METRICS = ["success", "mrr", "ndcg", "precision_rel", "precision_gold", "recall_gold"]


def clean_judgements(df: DataFrame) -> DataFrame:
    """Rank to a number or null, relevance to an integer (null: 0), mode and doc trimmed."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    return df.withColumns({
        "rank": number("rank"),
        "relevance": F.coalesce(number("relevance"), F.lit(0.0)).cast("int"),
        "mode": F.trim("mode"),
        "doc": F.trim(F.col("doc").cast("string")),
    })


def parse_gold(gold: Column) -> Column:
    """Distinct items of a comma list; quotes around it and blanks do not count."""
    bare = F.regexp_replace(F.trim(F.coalesce(gold, F.lit(""))), "^[\"']+|[\"']+$", "")
    return F.array_distinct(F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: x != ""))


def ranked(df: DataFrame, k: int | None = None) -> DataFrame:
    """Rows with all keys and a rank, numbered by rank within a query; the first ``k``."""
    w = Window.partitionBy(*KEYS).orderBy("rank", "doc")
    rows = df.dropna(subset=[*KEYS, "rank"]).withColumn("pos", F.row_number().over(w))
    return rows.filter(F.col("pos") <= k) if k else rows


def gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance) - 1


def per_query(df: DataFrame, k: int = 5) -> DataFrame:
    """The metric table: one row per (qid, difficulty, mode)."""
    ideal = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("relevance"), "pos"))
    top = ranked(df, k).withColumn("ideal_pos", ideal)
    hit = F.col("relevance") >= 1
    agg = top.groupBy(*KEYS).agg(
        F.min("question").alias("question"),
        F.min("gold").alias("gold_set"),
        F.max(hit.cast("int")).alias("success"),
        F.coalesce(1.0 / F.min(F.when(hit, F.col("pos"))), F.lit(0.0)).alias("mrr"),
        F.sum(gain(F.col("relevance")) / F.log2(F.col("pos") + 1)).alias("dcg"),
        F.sum(gain(F.col("relevance")) / F.log2(F.col("ideal_pos") + 1)).alias("idcg"),
        F.avg(hit.cast("double")).alias("precision_rel"),
        F.collect_set("doc").alias("docs"),
    )
    gold = parse_gold(F.col("gold_set"))
    hits = F.size(F.array_intersect("docs", gold))
    return agg.select(
        *KEYS, "question", "gold_set", F.lit(k).alias("k"), "success", "mrr",
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        "precision_rel",
        (hits / F.lit(float(k))).alias("precision_gold"),
        (hits / F.nullif(F.size(gold), F.lit(0))).alias("recall_gold"),
        F.size(gold).alias("gold_size"), hits.alias("hits"),
    )


def dcg(df: DataFrame, k: int = 5) -> DataFrame:
    """Discounted cumulative gain of the first ``k`` rows of each query."""
    return ranked(df, k).groupBy(*KEYS).agg(F.sum(gain(F.col("relevance")) / F.log2(F.col("pos") + 1)).alias("dcg"))


def strict_success(df: DataFrame) -> DataFrame:
    """Whether any row of a query has relevance 2, however far down."""
    return df.filter(F.col("difficulty").isin("easy", "difficult")).groupBy(*KEYS).agg(F.max((F.col("relevance") == 2).cast("int")).alias("success"))


def ndcg_by_rank(df: DataFrame) -> DataFrame:
    """nDCG over all rows, discounted by the rank's value; the ideal by 1..n."""
    ideal = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("relevance"), "pos"))
    agg = ranked(df).withColumn("ideal_pos", ideal).groupBy(*KEYS).agg(
        F.sum(gain(F.col("relevance")) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(gain(F.col("relevance")) / F.log2(F.col("ideal_pos") + 1)).alias("idcg"),
    )
    return agg.select(*KEYS, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def run_eval(hits: DataFrame, tests: DataFrame, k: int = 3) -> DataFrame:
    """Per test query: retrieved ids, any relevant in the first ``k``, first relevant.

    ``hits``: id, rank, doc_id, section_id; ``tests``: id, query, relevant_chunk_ids.
    """
    got = hits.withColumn("got", F.coalesce(F.nullif("doc_id", F.lit("")), F.nullif("section_id", F.lit("")))).filter((F.col("rank") <= k) & F.col("got").isNotNull())
    lists = got.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "got"))), lambda x: x["got"]).alias("retrieved_ids"))
    asked = tests.filter(F.coalesce(F.trim("query"), F.lit("")) != "")
    ids = F.coalesce("retrieved_ids", F.array().cast("array<string>"))
    return asked.join(lists, "id", "left").select(
        "id", "query", ids.alias("retrieved_ids"),
        F.coalesce(F.arrays_overlap(ids, "relevant_chunk_ids"), F.lit(False)).alias("success_at_k"),
        F.coalesce(F.array_contains("relevant_chunk_ids", F.try_element_at(ids, F.lit(1))), F.lit(False)).alias("top1_relevant"),
    )


def run_with(retrieve_fn, tests: DataFrame, k: int = 3) -> DataFrame:
    """``run_eval`` of what ``retrieve_fn(queries, k)`` finds; ``queries``: id, query, blank ones left out."""
    asked = tests.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    return run_eval(retrieve_fn(asked.select("id", "query"), k), asked, k)


def run_rates(results: DataFrame) -> DataFrame:
    """Counts and rates over a run."""
    ok, first = F.sum(F.col("success_at_k").cast("long")), F.sum(F.col("top1_relevant").cast("long"))
    n = F.count(F.lit(1))
    return results.agg(n.alias("queries"), ok.alias("successes"), first.alias("top1"), (ok / n).alias("success_rate"), (first / n).alias("top1_rate"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that ``df`` lacks."""
    return sorted(set(required) - set(df.columns))


def null_shares(df: DataFrame) -> DataFrame:
    """Share of nulls per column."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column", "null_share")


def range_violations(df: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Values under 0 or over 1 per metric."""
    one = df.agg(*(F.count_if((F.col(m) < 0) | (F.col(m) > 1)).alias(m) for m in metrics))
    return one.unpivot([], metrics, "metric", "violations")


def off_grid(df: DataFrame, column: str, allowed: list[float]) -> DataFrame:
    """Distinct values that are none of the allowed ones (to six places)."""
    return df.select(F.round(F.col(column), 6).alias("value")).filter(F.col("value").isNotNull() & ~F.round("value", 6).isin([round(a, 6) for a in allowed])).distinct()


def logical_mismatches(df: DataFrame) -> DataFrame:
    """Rows that contradict themselves, and gold-size and invariant violations."""
    return df.agg(
        F.count_if((F.col("success") == 0) & (F.col("recall_gold") > 0)).alias("recall_without_success"),
        F.count_if((F.col("mrr") > 0) & (F.col("success") == 0)).alias("mrr_without_success"),
        F.count_if(F.col("gold_size") <= 0).alias("empty_gold"),
        F.count_if(F.col("recall_gold") > 1).alias("recall_above_one"),
        F.count_if((F.col("hits") > F.col("gold_size")) | (F.col("hits") > F.col("k"))).alias("too_many_hits"),
    )


def rows_per_query(df: DataFrame) -> DataFrame:
    """Describe how many judged rows (qid, mode) pairs have."""
    n = df.groupBy("qid", "mode").agg(F.count(F.lit(1)).alias("n"))
    return describe(n, ["n"])


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """N, mean, sample SD, min, quartiles, max; one row per column (and group)."""
    by = by or []
    long = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(by, columns, "metric", "value").filter("value is not null")
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    q = [r(F.percentile("value", p)).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    return long.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("sd"), r(F.min("value")).alias("min"), *q, r(F.max("value")).alias("max"))


def unique_gold_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("qid").agg(F.min("gold_size").alias("gold_size"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts of values and their shares."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def order_of(column: str, order: list[str]) -> Column:
    """Place of a value in a display order."""
    return F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column))


def failures(metrics: DataFrame, modes: list[str]) -> DataFrame:
    """Failed queries, how many modes fail each, and their place in their mode's stack."""
    failed = metrics.filter("success = 0").select("qid", "difficulty", "mode")
    severity = failed.groupBy("qid").agg(F.countDistinct("mode").alias("severity"))
    joined = failed.join(severity, "qid", "left")
    place = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("severity"), "qid", "difficulty"))
    return joined.select("qid", "difficulty", "mode", "severity", order_of("mode", modes).alias("mode_order"), place.alias("stack_pos"))


def ecdf(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Sorted values with i/n; ties keep places of their own."""
    rows = df.filter(F.col(column).isNotNull())
    w = Window.partitionBy(*by)
    return rows.select(*by, F.col(column).alias("value"), (F.row_number().over(w.orderBy(column, "qid")) / F.count(F.lit(1)).over(w)).alias("share"))


def group_summary(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.median(column).alias("median"), F.min(column).alias("min"), F.max(column).alias("max"))


def quantile_table(df: DataFrame, column: str, by: list[str], digits: int = 3) -> DataFrame:
    """10, 25, 50, 75 and 90 % quantiles, one column each."""
    return df.groupBy(*by).agg(*(F.round(F.percentile(column, p / 100), digits).alias(f"q{p}") for p in (10, 25, 50, 75, 90)))


def boundary_mass(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Percent of values that are exactly 1 and exactly 0."""
    pct = lambda v: F.avg((F.col(column) == v).cast("double")) * 100
    return df.groupBy(*by).agg(pct(1.0).alias("pct_one"), pct(0.0).alias("pct_zero"))


def reindexed(df: DataFrame, difficulties: list[str], modes: list[str]) -> DataFrame:
    """All difficulty and mode combinations, null where ``df`` has none."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(d, m) for d in difficulties for m in modes], "difficulty string, mode string")
    return F.broadcast(grid).join(df, ["difficulty", "mode"], "left")
