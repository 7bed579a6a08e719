"""Registered queries of the retrieval and evaluation operators, with their SQL.

Judgements are made from ``lineitem``: parts are queries, line numbers choose the
mode, suppliers are documents.  All queries run over whole tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronsift.functions import text as T
from heronsift.operators import chunking as C
from heronsift.operators import metrics as M
from heronsift.operators import retrieval as R
from heronsift.operators import uncertainty as A
from heronsift.sources import chunks as S
from heronsift.streaming import ingest as I

MODES = ["BM25", "vector", "bm_vector_fusion", "bm_vector_fusion_rerank"]
DIFFICULTIES = ["easy", "difficult"]
BY = ["difficulty", "mode"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int | None = 6):
    """Register a query; its doubles (and the SQL's) are rounded alike."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            if digits is not None:
                df = df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))
            return df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("qid", "mode").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    mode = F.element_at(F.array(*(F.lit(m) for m in MODES)), F.pmod("l_linenumber", F.lit(4)) + 1)
    rows = li.withColumn("qid", F.col("l_partkey")).withColumn("mode", mode).withColumn("doc", F.col("l_suppkey").cast("string"))
    gold = rows.filter("l_discount >= 0.08").groupBy("qid").agg(F.array_join(F.sort_array(F.collect_set("doc")), ",").alias("gold"))
    j = rows.select(
        "qid", F.when(F.pmod("qid", F.lit(2)) == 0, "easy").otherwise("difficult").alias("difficulty"), "mode", "doc",
        F.row_number().over(w).alias("rank"), F.pmod(F.col("l_quantity").cast("int"), F.lit(3)).alias("relevance"), F.concat(F.lit("Question "), F.col("qid").cast("string")).alias("question"),
    )
    return M.clean_judgements(j.join(gold, "qid", "left"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.per_query(judgements(spark, sf_dir))


J = """
WITH rows0 AS (
  SELECT l_partkey AS qid, list_extract(['BM25', 'vector', 'bm_vector_fusion', 'bm_vector_fusion_rerank'], CAST(l_linenumber % 4 + 1 AS INT)) AS mode,
         CAST(l_suppkey AS VARCHAR) AS doc, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount FROM lineitem),
golds AS (SELECT qid, string_agg(DISTINCT doc, ',' ORDER BY doc) AS gold FROM rows0 WHERE l_discount >= 0.08 GROUP BY qid),
judgement AS (
  SELECT r.qid, CASE WHEN r.qid % 2 = 0 THEN 'easy' ELSE 'difficult' END AS difficulty, r.mode, r.doc,
         CAST(row_number() OVER (PARTITION BY r.qid, r.mode ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS DOUBLE) AS rank,
         CAST(l_quantity AS INT) % 3 AS relevance, 'Question ' || r.qid AS question, g.gold
  FROM rows0 r LEFT JOIN golds g ON r.qid = g.qid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, difficulty, mode ORDER BY rank, doc) AS pos FROM judgement),
ideal AS (SELECT *, row_number() OVER (PARTITION BY qid, difficulty, mode ORDER BY relevance DESC, pos) AS ipos FROM ranked),
top5 AS (SELECT *, row_number() OVER (PARTITION BY qid, difficulty, mode ORDER BY relevance DESC, pos) AS ipos FROM ranked WHERE pos <= 5),
agg AS (
  SELECT qid, difficulty, mode, min(question) AS question, min(gold) AS gold_set, 5 AS k,
         max(CAST(relevance >= 1 AS INT)) AS success, coalesce(1.0 / min(pos) FILTER (WHERE relevance >= 1), 0.0) AS mrr,
         sum((pow(2, relevance) - 1) / log2(pos + 1)) AS dcg, sum((pow(2, relevance) - 1) / log2(ipos + 1)) AS idcg,
         avg(CAST(relevance >= 1 AS DOUBLE)) AS precision_rel, list(DISTINCT doc) AS docs,
         CASE WHEN min(gold) IS NULL THEN [] ELSE list_distinct(string_split(min(gold), ',')) END AS gold_list
  FROM top5 GROUP BY qid, difficulty, mode),
m AS (
  SELECT qid, difficulty, mode, question, gold_set, k, success, mrr, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg, precision_rel,
         len(list_intersect(docs, gold_list)) / 5.0 AS precision_gold,
         len(list_intersect(docs, gold_list)) / nullif(len(gold_list), 0) AS recall_gold,
         CAST(len(gold_list) AS INT) AS gold_size, CAST(len(list_intersect(docs, gold_list)) AS INT) AS hits
  FROM agg)
"""
R6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)


@query(J + f"SELECT qid, difficulty, mode, question, gold_set, k, success, {R6('mrr', 'ndcg', 'precision_rel', 'precision_gold', 'recall_gold')}, gold_size, hits FROM m")
def m10_per_query_metrics(spark, sf):
    """Success, MRR, nDCG, precision and recall at 5 of every query."""
    return metric_rows(spark, sf)


@query(J + "SELECT qid, difficulty, mode, round(sum((pow(2, relevance) - 1) / log2(pos + 1)), 6) AS dcg FROM top5 GROUP BY ALL")
def m04_dcg(spark, sf):
    return M.dcg(judgements(spark, sf))


@query("SELECT l_orderkey, l_linenumber, list_sort(list_distinct(list_filter(list_transform(string_split(l_returnflag || ', ' || l_linestatus || ',,' || l_returnflag, ','), lambda x: trim(x)), lambda x: x <> ''))) AS gold FROM lineitem")
def m01_parse_gold(spark, sf):
    """Comma lists as sets."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.sort_array(M.parse_gold(F.concat(F.lit('"'), "l_returnflag", F.lit(", "), "l_linestatus", F.lit(",,"), "l_returnflag", F.lit('"')))).alias("gold"))


@query(J + "SELECT qid, difficulty, mode, max(CAST(relevance = 2 AS INT)) AS success FROM judgement GROUP BY ALL")
def m11_strict_success(spark, sf):
    return M.strict_success(judgements(spark, sf))


@query(J + "SELECT qid, difficulty, mode, round(CASE WHEN sum((pow(2, relevance) - 1) / log2(ipos + 1)) > 0 THEN sum((pow(2, relevance) - 1) / log2(rank + 1)) / sum((pow(2, relevance) - 1) / log2(ipos + 1)) ELSE 0.0 END, 6) AS ndcg FROM ideal GROUP BY qid, difficulty, mode")
def m12_ndcg_all_ranks(spark, sf):
    return M.ndcg_by_rank(judgements(spark, sf))


RUN = J + """, hits AS (SELECT CAST(qid AS VARCHAR) || '/' || mode AS id, rank, doc FROM judgement WHERE rank <= 3),
lists AS (SELECT id, list(doc ORDER BY rank) AS retrieved FROM hits GROUP BY id),
tests AS (SELECT CAST(qid AS VARCHAR) || '/' || mode AS id, min(question) AS query, CASE WHEN min(gold) IS NULL THEN [] ELSE list_distinct(string_split(min(gold), ',')) END AS relevant FROM judgement GROUP BY qid, mode),
run AS (SELECT t.id, t.query, array_to_string(l.retrieved, ',') AS retrieved_ids, len(list_intersect(l.retrieved, t.relevant)) > 0 AS success_at_k, list_contains(t.relevant, l.retrieved[1]) AS top1_relevant FROM tests t JOIN lists l ON t.id = l.id)
"""


def run_results(spark, sf):
    j = judgements(spark, sf).withColumn("id", F.concat(F.col("qid").cast("string"), F.lit("/"), "mode"))
    odd = F.pmod("qid", F.lit(2)) == 1  # these hits are known by their section only
    hits = j.select("id", "rank", F.when(~odd, F.col("doc")).alias("doc_id"), F.when(odd, F.col("doc")).alias("section_id"))
    tests = j.groupBy("id").agg(F.min("question").alias("query"), M.parse_gold(F.min("gold")).alias("relevant_chunk_ids"))
    return M.run_eval(hits, tests)


@query(RUN + "SELECT * FROM run")
def m13_run_eval(spark, sf):
    """Retrieved ids, success at 3 and first hit of every test query."""
    return run_results(spark, sf).withColumn("retrieved_ids", F.array_join("retrieved_ids", ","))


@query(RUN + "SELECT count(*) AS queries, CAST(sum(CAST(success_at_k AS INT)) AS BIGINT) AS successes, CAST(sum(CAST(top1_relevant AS INT)) AS BIGINT) AS top1, round(avg(CAST(success_at_k AS DOUBLE)), 6) AS success_rate, round(avg(CAST(top1_relevant AS DOUBLE)), 6) AS top1_rate FROM run")
def m14_run_rates(spark, sf):
    return M.run_rates(run_results(spark, sf))


@query(J + "UNPIVOT (SELECT " + ", ".join(f"round(avg(CAST({c} IS NULL AS DOUBLE)), 6) AS {c}" for c in ("qid", "gold_set", *M.METRICS, "gold_size")) + ' FROM m) ON COLUMNS(*) INTO NAME "column" VALUE null_share')
def m15b_null_shares(spark, sf):
    return M.null_shares(metric_rows(spark, sf).select("qid", "gold_set", *M.METRICS, "gold_size"))


@query(J + "UNPIVOT (SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} < 0 OR {c} > 1) AS {c}" for c in M.METRICS) + " FROM m) ON COLUMNS(*) INTO NAME metric VALUE violations")
def m15c_range_violations(spark, sf):
    return M.range_violations(metric_rows(spark, sf))


@query(J + "SELECT DISTINCT round(precision_rel, 6) AS value FROM m WHERE round(precision_rel, 6) NOT IN (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)")
def m15d_off_grid(spark, sf):
    return M.off_grid(metric_rows(spark, sf), "precision_rel", [i / 5 for i in range(6)])


@query(J + (
    "SELECT count(*) FILTER (WHERE success = 0 AND recall_gold > 0) AS recall_without_success, count(*) FILTER (WHERE mrr > 0 AND success = 0) AS mrr_without_success, "
    "count(*) FILTER (WHERE gold_size <= 0) AS empty_gold, count(*) FILTER (WHERE recall_gold > 1) AS recall_above_one, count(*) FILTER (WHERE hits > gold_size OR hits > k) "
    "AS too_many_hits FROM m"
))
def m15eg_mismatches(spark, sf):
    """Contradictions, empty gold sets and broken invariants (M09, M15e, M15g)."""
    return M.logical_mismatches(metric_rows(spark, sf))


def _described(source: str, columns: list[str], digits: int, by: str = "") -> str:
    one = (
        "SELECT {by}'{c}' AS metric, count({c}) AS n, round(avg({c}), {d}) AS mean, round(stddev_samp({c}), {d}) AS sd, round(min({c}), {d}) AS min, round(quantile_cont({c}, "
        "0.25), {d}) AS q25, round(quantile_cont({c}, 0.5), {d}) AS median, round(quantile_cont({c}, 0.75), {d}) AS q75, round(max({c}), {d}) AS max FROM {s}{g}"
    )
    return " UNION ALL ".join(one.format(by=by and by + ", ", c=c, d=digits, s=source, g=by and f" GROUP BY {by}") for c in columns)


@query(J + ", per AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM judgement GROUP BY qid, mode) " + _described("per", ["n"], 6))
def m15f_rows_per_query(spark, sf):
    return M.rows_per_query(judgements(spark, sf))


@query(J + ", md AS (SELECT * REPLACE (CAST(success AS DOUBLE) AS success) FROM m) " + _described("md", M.METRICS, 3))
def m16_general_table(spark, sf):
    """N, mean, SD, min, quartiles and max per metric (also M15h, M26)."""
    return M.describe(metric_rows(spark, sf), M.METRICS, digits=3)


@query(J + "SELECT qid, min(gold_size) AS gold_size FROM m GROUP BY qid")
def m17_unique_gold(spark, sf):
    return M.unique_gold_sizes(metric_rows(spark, sf))


@query(J + "SELECT hits, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m WHERE difficulty = 'easy' GROUP BY hits")
def m18_value_shares(spark, sf):
    return M.value_shares(metric_rows(spark, sf).filter("difficulty = 'easy'"), "hits")


@query(J + "SELECT qid, difficulty, mode, round(mrr, 6) AS mrr FROM m WHERE mode IN ('BM25', 'vector') AND difficulty IN ('easy') ORDER BY mode, mrr DESC, qid")
def m19_filter_sort(spark, sf):
    rows = metric_rows(spark, sf).filter(F.col("mode").isin("BM25", "vector") & F.col("difficulty").isin("easy"))
    return rows.select("qid", "difficulty", "mode", "mrr").orderBy("mode", F.desc("mrr"), "qid")


@query(J + f""", f AS (SELECT qid, difficulty, mode FROM m WHERE success = 0), s AS (SELECT qid, count(DISTINCT mode) AS severity FROM f GROUP BY qid)
SELECT f.qid, f.difficulty, f.mode, s.severity, CAST(list_position({MODES}, f.mode) AS BIGINT) AS mode_order, CAST(row_number() OVER (PARTITION BY f.mode ORDER BY s.severity DESC, f.qid, f.difficulty) AS INT) AS stack_pos FROM f LEFT JOIN s ON f.qid = s.qid""")
def m20_failures(spark, sf):
    """Failed queries with severity, display order and stacking place (M20a to M20d)."""
    return M.failures(metric_rows(spark, sf), MODES)


@query(J + "SELECT mode, round(ndcg, 6) AS value, round(row_number() OVER (PARTITION BY mode ORDER BY ndcg, qid) / count(*) OVER (PARTITION BY mode), 6) AS share FROM m")
def m21_ecdf(spark, sf):
    return M.ecdf(metric_rows(spark, sf), "ndcg", ["mode"])


@query(J + "SELECT difficulty, mode, round(avg(ndcg), 6) AS mean, round(median(ndcg), 6) AS median, round(min(ndcg), 6) AS min, round(max(ndcg), 6) AS max FROM m GROUP BY ALL")
def m22_group_summary(spark, sf):
    return M.group_summary(metric_rows(spark, sf), "ndcg", BY)


@query(J + "SELECT difficulty, mode, " + ", ".join(f"round(quantile_cont(ndcg, {p / 100}), 3) AS q{p}" for p in (10, 25, 50, 75, 90)) + " FROM m GROUP BY ALL")
def m23_quantiles(spark, sf):
    return M.quantile_table(metric_rows(spark, sf), "ndcg", BY)


@query(J + "SELECT difficulty, mode, round(avg(CAST(ndcg = 1 AS DOUBLE)) * 100, 6) AS pct_one, round(avg(CAST(ndcg = 0 AS DOUBLE)) * 100, 6) AS pct_zero FROM (SELECT * REPLACE (round(ndcg, 9) AS ndcg) FROM m) GROUP BY ALL")
def m24_boundary_mass(spark, sf):
    return M.boundary_mass(metric_rows(spark, sf).withColumn("ndcg", F.round("ndcg", 9)), "ndcg", BY)


@query(J + f"""SELECT d.difficulty, e.mode, g.n FROM (SELECT unnest({[*DIFFICULTIES, 'unseen']}) AS difficulty) d CROSS JOIN (SELECT unnest({MODES}) AS mode) e
LEFT JOIN (SELECT difficulty, mode, count(*) AS n FROM m GROUP BY ALL) g ON d.difficulty = g.difficulty AND e.mode = g.mode""")
def m25_reindex(spark, sf):
    return M.reindexed(metric_rows(spark, sf).groupBy(*BY).agg(F.count(F.lit(1)).alias("n")), [*DIFFICULTIES, "unseen"], MODES)


RATES = J + ", r AS (SELECT difficulty, mode, count(*) AS n, CAST(sum(success) AS BIGINT) AS successes, sum(success) / count(*) AS rate FROM m GROUP BY difficulty, mode)"
WILSON = "(rate + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) {s} 1.959963984540054 * sqrt(rate * (1 - rate) / n + 3.841458820694124 / (4.0 * n * n)) / (1 + 3.841458820694124 / n)"


@query(RATES + f" SELECT difficulty, mode, n, successes, round(rate, 6) AS rate, round({WILSON.format(s='-')}, 6) AS lo, round({WILSON.format(s='+')}, 6) AS hi, round((successes + 0.5) / (n + 1.0), 6) AS posterior_mean FROM r")
def a01_rates_wilson_beta(spark, sf):
    """Success rates with Wilson bounds and posterior means."""
    r = A.rates(metric_rows(spark, sf), "success", BY)
    lo, hi = A.wilson(F.col("n"), F.col("rate"))
    return r.withColumn("lo", lo).withColumn("hi", hi).withColumn("posterior_mean", A.beta_mean(F.col("successes"), F.col("n")))


def credible(source: str, prior: float) -> str:
    """SQL of ``cred``: the density of each group's beta on 100,000 cells, summed up to both bounds.

    The cells are even in the angle whose squared sine is the rate, where the density has no poles.
    """
    part = "PARTITION BY difficulty, mode"
    return f""", post AS (SELECT difficulty, mode, successes + {prior} AS pa, n - successes + {prior} AS pb FROM {source}),
dens AS (SELECT difficulty, mode, i, (2 * pa - 1) * ln(sin(pi() / 2 * (i + 0.5) / 100000)) + (2 * pb - 1) * ln(cos(pi() / 2 * (i + 0.5) / 100000)) AS l FROM post, range(100000) t(i)),
mass AS (SELECT difficulty, mode, i, exp(l - max(l) OVER ({part})) AS w FROM dens),
cum AS (SELECT difficulty, mode, i, w / sum(w) OVER ({part}) AS p, sum(w) OVER ({part} ORDER BY i) / sum(w) OVER ({part}) AS c FROM mass),
cred AS (SELECT difficulty, mode, pow(sin(pi() / 2 * arg_min((i + 1 - (c - 0.025) / p) / 100000, i) FILTER (WHERE c >= 0.025)), 2) AS cri_lo, pow(sin(pi() / 2 * arg_min((i + 1 - (c - 0.975) / p) / 100000, i) FILTER (WHERE c >= 0.975)), 2) AS cri_hi FROM cum GROUP BY difficulty, mode)"""


CRED = RATES + credible("r", 0.5) + ", rated AS (SELECT r.*, (successes + 0.5) / (n + 1.0) AS posterior_mean, cri_lo, cri_hi FROM r JOIN cred ON r.difficulty = cred.difficulty AND r.mode = cred.mode)"


@query(CRED + " SELECT difficulty, mode, n, successes, round(rate, 5) AS rate, round(posterior_mean, 5) AS posterior_mean, round(cri_lo, 5) AS cri_lo, round(cri_hi, 5) AS cri_hi FROM rated", digits=5)
def a03_beta_interval(spark, sf):
    """Posterior means and equal-tailed bounds of success rates."""
    return A.beta_interval(A.rates(metric_rows(spark, sf), "success", BY))


@query(CRED + f""" SELECT difficulty, mode, n, round(rate, 3) AS rate, printf('[%.3f, %.3f]', {WILSON.format(s='-')}, {WILSON.format(s='+')}) AS interval, round(posterior_mean, 3) AS posterior_mean,
printf('[%.3f, %.3f]', cri_lo, cri_hi) AS credible, round(least({WILSON.format(s='-')}, cri_lo), 3) AS low FROM rated""")
def a04_report(spark, sf):
    """Rates with both formatted intervals and the lower of their lower bounds."""
    return A.report(A.rates(metric_rows(spark, sf), "success", BY), BY)


NUMBERED = J + ", x AS (SELECT difficulty, mode, qid, {c} AS x, row_number() OVER (PARTITION BY difficulty, mode ORDER BY qid) - 1 AS i, count(*) OVER (PARTITION BY difficulty, mode) AS n FROM m WHERE {c} IS NOT NULL), d AS (SELECT *, unnest(range(50)) AS b FROM x), "
INDEXED = NUMBERED + (
    "g AS (SELECT d.difficulty, d.mode, d.b, y.x FROM d JOIN x y ON d.difficulty = y.difficulty AND d.mode = y.mode AND y.i = CAST('0x' || substr(md5(d.difficulty || '/' || "
    "d.mode || '|' || d.b || '|' || d.i), 1, 12) AS BIGINT) % d.n), s AS (SELECT difficulty, mode, b, {s} AS s FROM g GROUP BY ALL) SELECT difficulty, mode, "
    "round(quantile_cont(s, 0.025), 5) AS lo, round(quantile_cont(s, 0.975), 5) AS hi FROM s GROUP BY ALL"
)


@query(INDEXED.format(c="mrr", s="avg(x)"), digits=5)
def a05_bootstrap_mean(spark, sf):
    """Percentile bootstrap of the mean."""
    return A.bootstrap(metric_rows(spark, sf), "mrr", BY, draws=50)


@query(INDEXED.format(c="ndcg", s="median(x)"), digits=5)
def a16_bootstrap_median(spark, sf):
    return A.bootstrap(metric_rows(spark, sf), "ndcg", BY, draws=50, statistic="median")


WEIGHED = NUMBERED + "w AS (SELECT difficulty, mode, b, i, x, -ln((CAST(CAST('0x' || substr(md5(difficulty || '/' || mode || '|' || b || '|' || i), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0) AS w FROM d), "


@query(WEIGHED.format(c="mrr") + "s AS (SELECT difficulty, mode, b, sum(w * x) / sum(w) AS s FROM w GROUP BY ALL) SELECT difficulty, mode, round(quantile_cont(s, 0.025), 5) AS lo, round(quantile_cont(s, 0.975), 5) AS hi FROM s GROUP BY ALL", digits=5)
def a07_bayes_bootstrap(spark, sf):
    return A.bayes_bootstrap(metric_rows(spark, sf), "mrr", BY, draws=50)


@query(WEIGHED.format(c="ndcg") + (
    "c AS (SELECT *, sum(w) OVER (PARTITION BY difficulty, mode, b ORDER BY x, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER (PARTITION BY difficulty, "
    "mode, b) AS cum FROM w), s AS (SELECT difficulty, mode, b, min(x) FILTER (WHERE cum >= 0.5) AS s FROM c GROUP BY ALL) SELECT difficulty, mode, round(quantile_cont(s, "
    "0.025), 5) AS lo, round(quantile_cont(s, 0.975), 5) AS hi FROM s GROUP BY ALL"
), digits=5)
def a17_bayes_median(spark, sf):
    return A.bayes_bootstrap(metric_rows(spark, sf), "ndcg", BY, draws=50, statistic="median")


@query()
def a06_bootstrap_full(spark, sf):
    """Bootstrap of the mean with the reference's 10,000 draws over counts of values (A05), tested against its normal limit."""
    return A.resampled(metric_rows(spark, sf), "mrr", BY, draws=10_000)


@query()
def a17_bayes_median_full(spark, sf):
    """Bootstrap and Bayesian bootstrap of the median with 10,000 draws (A16, A17), tested likewise."""
    rows = metric_rows(spark, sf)
    kinds = [A.resampled(rows, "ndcg", BY, 10_000, "median", bayes).withColumn("bayesian", F.lit(bayes)) for bayes in (False, True)]
    return kinds[0].unionByName(kinds[1])


@query()
def a08_dirichlet_mrr(spark, sf):
    """Posterior of the mean reciprocal rank per group, tested against its exact mean and deviation."""
    return A.dirichlet_mrr(metric_rows(spark, sf), BY, draws=50_000)


@query(J + "SELECT mode, count(*) AS n, round(avg(mrr), 6) AS mean, round(avg(CAST(mrr = 1 AS DOUBLE)), 6) AS rank1_rate FROM m GROUP BY mode")
def a09_mrr_summary(spark, sf):
    return metric_rows(spark, sf).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.avg("mrr").alias("mean"), F.avg((F.col("mrr") == 1).cast("double")).alias("rank1_rate"))


@query(J + "SELECT difficulty, mode, CAST(grouping(difficulty, mode) AS BIGINT) AS level, count(ndcg) AS n, round(avg(ndcg), 6) AS mean FROM m GROUP BY CUBE (difficulty, mode)")
def a10_cube(spark, sf):
    """Means at all aggregation levels in one pass."""
    return A.cube_means(metric_rows(spark, sf), "ndcg")


@query()
def a12_zoib_mean(spark, sf):
    """Zero-one-inflated beta means with bounds by 20,000 draws (A11, A12), tested against the Dirichlet's exact moments."""
    return A.zoib_mean(metric_rows(spark, sf), "ndcg", BY)


@query()
def a13_ndcg_summary(spark, sf):
    """Twelve fields per group."""
    return A.ndcg_summary(metric_rows(spark, sf), "ndcg", BY)


@query()
def a13_ndcg_pair(spark, sf):
    """Bootstrap and Bayesian bootstrap of the mean side by side, 20,000 draws."""
    return A.ndcg_pair(metric_rows(spark, sf), "ndcg", BY)


@query(J + ", md AS (SELECT difficulty, precision_gold, recall_gold FROM m) " + _described("md", ["precision_gold", "recall_gold"], 6, "difficulty"))
def a14_group_tables(spark, sf):
    return M.describe(metric_rows(spark, sf), ["precision_gold", "recall_gold"], ["difficulty"])


@query()
def a14_gold_summary(spark, sf):
    """Precision and recall per group: size, mean with bootstrap bounds, median and quartiles."""
    rows = metric_rows(spark, sf)
    kinds = [A.gold_summary(rows, c, BY).withColumn("metric", F.lit(c)) for c in ("precision_gold", "recall_gold")]
    return kinds[0].unionByName(kinds[1])


HITS = J + ", h AS (SELECT difficulty, mode, CAST(sum(greatest(0, least(5, round(precision_gold * 5)))) AS BIGINT) AS successes, count(*) * 5 AS n FROM m WHERE precision_gold IS NOT NULL GROUP BY difficulty, mode)"


@query(HITS + credible("h", 1.0) + " SELECT h.difficulty, h.mode, successes, n, round((successes + 1) / (n + 2), 5) AS posterior_mean, round(cri_lo, 5) AS cri_lo, round(cri_hi, 5) AS cri_hi FROM h JOIN cred ON h.difficulty = cred.difficulty AND h.mode = cred.mode", digits=5)
def a15_precision_posterior(spark, sf):
    return A.precision_posterior(metric_rows(spark, sf), BY)


@query(CRED + f", w AS (SELECT difficulty, mode, least({WILSON.format(s='-')}, cri_lo) AS low FROM rated) SELECT difficulty, mode, round(low, 5) AS low, round(min(low) OVER (PARTITION BY difficulty), 5) AS panel_low FROM w", digits=5)
def a18_conservative_bound(spark, sf):
    """The lower of both intervals' lower bounds, per row and per panel."""
    return A.conservative_bound(A.rates(metric_rows(spark, sf), "success", BY), BY, "difficulty")


@query(J + "SELECT difficulty, mode, round(avg(precision_gold), 6) AS precision, round(avg(recall_gold), 6) AS recall FROM m GROUP BY ALL")
def a19_trade_off(spark, sf):
    return A.trade_off(metric_rows(spark, sf))


@query(J + "SELECT qid, difficulty, mode, 1 AS intercept, CAST(difficulty <> 'easy' AS INT) AS x_difficulty, " + ", ".join(f"CAST(mode = '{m}' AS INT) AS x_mode{k}, CAST(mode = '{m}' AND difficulty <> 'easy' AS INT) AS x_inter{k}" for k, m in enumerate(MODES[1:], 1)) + " FROM m")
def a20_design_matrix(spark, sf):
    return A.design_matrix(metric_rows(spark, sf), MODES, "easy")


EFFECTS = ["intercept", "x_difficulty", *(f"x_{kind}{k}" for kind in ("mode", "inter") for k in range(1, len(MODES)))]


def modelled(spark, sf, label: str, family: str) -> DataFrame:
    rows = metric_rows(spark, sf)
    return A.mixed_model(A.design_matrix(rows, MODES, "easy", label), label, EFFECTS, "qid", family, chains=4, tune=2000, draws=2000)


@query()
def a21_mixed_model(spark, sf):
    """Posterior draws of the mixed logistic model (A21; A23 with another label), tested on planted effects."""
    return modelled(spark, sf, "success", "bernoulli")


@query()
def a22_zoib_model(spark, sf):
    """Posterior draws of the zero-one-inflated beta mixed model (A22), tested on planted effects."""
    return modelled(spark, sf, "ndcg", "zoib")


@query()
def a24_beta_model(spark, sf):
    """Posterior draws of the conditional beta mixed model (A24), tested on planted effects."""
    return modelled(spark, sf, "ndcg", "beta")


@query()
def a29_fitted_effects(spark, sf):
    """Conditions of the fitted logistic model, their contrasts and main effects (A25, A28, A29 on a posterior)."""
    cells = A.model_conditions(modelled(spark, sf, "success", "bernoulli"), MODES, *DIFFICULTIES)
    return A.main_effects(cells, 8000, "BM25").select("effect", "mean", "lo", "hi", "p_greater")


#: Posterior draws made from md5, the same on both engines.
DRAWS = f"""
WITH u AS (SELECT s AS sample_id, {', '.join(f"(CAST(CAST('0x' || substr(md5('{n}|' || s), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS {n}" for n in ('b0', 'b_mode', 'b_diff'))} FROM (SELECT unnest(range(1000)) AS s)),
conditions AS (SELECT d.difficulty, e.mode, CAST(list_position({MODES}, e.mode) AS BIGINT) AS mode_ord, CAST(d.difficulty = 'difficult' AS INT) AS is_difficult FROM (SELECT unnest({DIFFICULTIES}) AS difficulty) d CROSS JOIN (SELECT unnest({MODES}) AS mode) e),
draws AS (SELECT difficulty, mode, mode_ord, sample_id, 1 / (1 + exp(-(b0 + (b_mode - 0.3) * mode_ord + (b_diff - 0.8) * is_difficult))) AS value FROM conditions, u)
"""


def draws(spark) -> DataFrame:
    u = spark.range(1000).withColumnRenamed("id", "sample_id")
    u = u.select("sample_id", *((A.md5_uniform(F.lit(n), F.col("sample_id")) - off).alias(n) for n, off in (("b0", 0.0), ("b_mode", 0.3), ("b_diff", 0.8))))
    grid = spark.createDataFrame([(d, m, k + 1, int(d == "difficult")) for d in DIFFICULTIES for k, m in enumerate(MODES)], "difficulty string, mode string, mode_ord long, is_difficult int")
    return A.condition_draws(grid, u)


@query(DRAWS + (
    ", w AS (SELECT *, lead(value, 950) OVER (PARTITION BY difficulty, mode ORDER BY value, sample_id) AS hi FROM draws), x AS (SELECT *, row_number() OVER (PARTITION BY "
    "difficulty, mode ORDER BY hi - value, value) AS rn FROM w WHERE hi IS NOT NULL), p AS (SELECT difficulty, mode, avg(value) AS mean FROM draws GROUP BY ALL) SELECT "
    "x.difficulty, x.mode, round(p.mean, 6) AS mean, round(x.value, 6) AS lo, round(x.hi, 6) AS hi FROM x JOIN p ON x.difficulty = p.difficulty AND x.mode = p.mode WHERE rn = "
    "1"
))
def a25_condition_hdi(spark, sf):
    """Means and narrowest intervals per condition (A25, A27), over md5 draws."""
    d = draws(spark)
    return d.groupBy(*BY).agg(F.avg("value").alias("mean")).join(A.hdi(d, BY, 1000), BY)


def narrowest(source: str, by: str) -> str:
    """SQL of mean, narrowest 95 % interval and share above 0 of 1000 draws per group."""
    return f""", led AS (SELECT *, lead(value, 950) OVER (PARTITION BY {by} ORDER BY value, sample_id) AS hi FROM {source}),
nr AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY hi - value, value) AS rn FROM led WHERE hi IS NOT NULL),
pm AS (SELECT {by}, avg(value) AS mean, avg(CAST(value > 0 AS DOUBLE)) AS p_greater FROM {source} GROUP BY {by}),
shown AS (SELECT pm.*, nr.value AS lo, nr.hi FROM pm JOIN nr USING ({by}) WHERE rn = 1) """


CONTRAST = """, c AS (SELECT {by}a.mode AS mode_a, b.mode AS mode_b, a.sample_id, a.value - b.value AS value FROM g a JOIN g b ON a.sample_id = b.sample_id AND a.mode_ord < b.mode_ord{on})"""
LABEL = "CASE WHEN p_greater >= 0.95 THEN 'strong A' WHEN p_greater >= 0.8 THEN 'moderate A' WHEN p_greater > 0.2 THEN 'inconclusive' WHEN p_greater > 0.05 THEN 'moderate B' ELSE 'strong B' END AS evidence"


@query(DRAWS + ", g AS (SELECT mode, mode_ord, sample_id, avg(value) AS value FROM draws GROUP BY ALL)" + CONTRAST.format(by="", on="") + narrowest("c", "mode_a, mode_b")
       + f"SELECT mode_a, mode_b, round(mean, 6) AS delta, round(p_greater, 6) AS p_greater, round(lo, 6) AS lo, round(hi, 6) AS hi, {LABEL} FROM shown")
def a28_contrasts(spark, sf):
    """Pairwise contrasts of modes with intervals and evidence labels (A28, A31), over md5 draws."""
    return A.contrasts(draws(spark), 1000)


@query(DRAWS + ", g AS (SELECT * FROM draws)" + CONTRAST.format(by="a.difficulty, ", on=" AND a.difficulty = b.difficulty") + narrowest("c", "difficulty, mode_a, mode_b")
       + f"SELECT difficulty, mode_a, mode_b, round(mean, 6) AS delta, round(p_greater, 6) AS p_greater, round(lo, 6) AS lo, round(hi, 6) AS hi, {LABEL} FROM shown")
def a28_contrasts_within(spark, sf):
    """The same within each difficulty (A28), over md5 draws."""
    return A.contrasts(draws(spark), 1000, ["difficulty"])


@query(DRAWS + """, g AS (SELECT mode, sample_id, avg(value) AS value FROM draws GROUP BY ALL),
c AS (SELECT 'easy - difficult' AS effect, sample_id, avg(CASE WHEN difficulty = 'easy' THEN value ELSE -value END) * 2 AS value FROM draws GROUP BY sample_id
UNION ALL SELECT a.mode || ' - BM25', a.sample_id, a.value - b.value FROM g a JOIN g b ON a.sample_id = b.sample_id AND b.mode = 'BM25' WHERE a.mode <> 'BM25')""" + narrowest("c", "effect")
       + "SELECT effect, round(mean, 6) AS mean, round(p_greater, 6) AS p_greater, round(lo, 6) AS lo, round(hi, 6) AS hi FROM shown")
def a29_main_effects(spark, sf):
    """Main effects of difficulty and of each mode against BM25 (A29), over md5 draws."""
    return A.main_effects(draws(spark), 1000, "BM25")


INFLATION = "e AS (SELECT s AS sample_id, {0} AS z1, {1} AS z2, {2} AS z3 FROM (SELECT unnest(range(1000)) AS s))".format(*(f"exp((CAST(CAST('0x' || substr(md5('z{k}|' || s), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)" for k in (1, 2, 3)))


@query(DRAWS + ", " + INFLATION + ", c AS (SELECT d.difficulty, d.mode, d.sample_id, z2 / (z1 + z2 + z3) + z3 / (z1 + z2 + z3) * d.value AS value FROM draws d JOIN e ON d.sample_id = e.sample_id)" + narrowest("c", "difficulty, mode")
       + "SELECT difficulty, mode, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM shown")
def a26_expected_values(spark, sf):
    """Expected values with inflation per draw: mean and narrowest interval (A26, A27), over md5 draws."""
    z = [F.exp(A.md5_uniform(F.lit(f"z{k}"), F.col("id"))) for k in (1, 2, 3)]
    total = z[0] + z[1] + z[2]
    inflation = spark.range(1000).select(F.col("id").alias("sample_id"), (z[1] / total).alias("p_one"), (z[2] / total).alias("p_middle"))
    return A.summary_of_draws(A.expected_values(draws(spark), inflation), BY, 1000).select(*BY, "mean", "lo", "hi")


@query(DRAWS + (
    ", g AS (SELECT mode, sample_id, max(value) FILTER (WHERE difficulty = 'difficult') - max(value) FILTER (WHERE difficulty = 'easy') AS gap FROM draws GROUP BY ALL) SELECT "
    "a.mode, round(avg(a.gap - b.gap), 6) AS did FROM g a JOIN g b ON a.sample_id = b.sample_id AND b.mode = 'BM25' WHERE a.mode <> 'BM25' GROUP BY a.mode"
))
def a30_interaction(spark, sf):
    return A.interaction(draws(spark), "BM25")


# Retrieval: documents are chunks, benchmark passages are queries.

WORDS = r"regexp_extract_all(lower({c}), '[a-z0-9]{{2,}}')"
BM25 = f"""
WITH tok AS (SELECT doc_id AS chunk_id, unnest({WORDS.format(c='text')}) AS term FROM documents),
dls AS (SELECT doc_id AS chunk_id, len({WORDS.format(c='text')}) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
dlu AS (SELECT chunk_id, max(dl) AS dl FROM dls GROUP BY chunk_id),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format(c='text')}) AS term FROM benchmark),
s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
      FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dlu USING (chunk_id), st GROUP BY query_id, chunk_id),
bm AS (SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s) WHERE rank <= 20)
"""


def chunk_table(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("title"))


def query_table(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@functools.lru_cache(maxsize=2)
def _index(application: str, spark, sf) -> dict[str, DataFrame]:
    return {name: df.persist() for name, df in R.bm25_index(chunk_table(spark, sf)).items()}


def index_of(spark, sf) -> dict[str, DataFrame]:
    """The corpus's index, made once per application and kept."""
    return _index(spark.sparkContext.applicationId, spark, sf)


def lexical(spark, sf) -> DataFrame:
    return R.bm25(index_of(spark, sf), query_table(spark, sf), digits=6)


@query(BM25 + "SELECT query_id, chunk_id, score, rank FROM bm")
def r02_bm25(spark, sf):
    """BM25 top 20 of every benchmark passage."""
    return lexical(spark, sf)


@query(BM25 + """, b AS (SELECT bm.query_id, bm.chunk_id, bm.score + CASE WHEN len(list_filter(string_split_regex(lower(k.text), '\\s+'), lambda w: w <> '' AND contains(lower(d.source), w))) > 0 THEN 5.0 ELSE 0.0 END AS score
FROM bm JOIN benchmark k ON k.item_id = bm.query_id JOIN (SELECT DISTINCT doc_id, source FROM documents) d ON d.doc_id = bm.chunk_id)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM b""")
def r03_boost(spark, sf):
    return R.boosted(lexical(spark, sf), query_table(spark, sf), chunk_table(spark, sf))


VECTOR = """
WITH v AS (SELECT vec_id, embedding, label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (q.norm * c.norm), 6) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0),
vt AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s) WHERE rank <= 20)
"""


def nearest(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return R.vector_top(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), q, digits=6)


@query(VECTOR + "SELECT query_id, chunk_id, score, rank FROM vt")
def r06_vector_top(spark, sf):
    """Cosine top 20 for the query set of every 50th vector."""
    return nearest(spark, sf)


@query(r"""
WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents),
c AS (SELECT id, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS INT) AS dim, CAST(count(*) AS DOUBLE) AS x FROM t GROUP BY ALL)
SELECT id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM c""")
def r04_hashed_embedding(spark, sf):
    return R.hashed_embedding(table(spark, sf, "documents"), "doc_id", "text")


@query(BM25 + """, tv AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id DESC) AS INT) AS rank FROM bm),
u AS (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT query_id, chunk_id, rank FROM tv),
f AS (SELECT query_id, chunk_id, round(sum(1.0 / (120 + rank)), 9) AS score FROM u GROUP BY ALL)
SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM f) WHERE rank <= 10""", digits=9)
def r07_reciprocal_fusion(spark, sf):
    """Fusion of a list with its reverse."""
    a = lexical(spark, sf)
    b = a.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", F.desc("chunk_id"))))
    return R.reciprocal_fusion([a, b], digits=9)


@query(BM25 + """, a AS (SELECT query_id, chunk_id, rank, 0 AS list_no FROM bm WHERE rank <= 3 UNION ALL SELECT query_id, chunk_id, rank - 1, 1 FROM bm WHERE rank BETWEEN 2 AND 4),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list_no, rank) AS one FROM a)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank) AS INT) AS rank FROM o WHERE one = 1""")
def r12_ordered_union(spark, sf):
    """Ordered union without repeats."""
    a = lexical(spark, sf).select("query_id", "chunk_id", "rank")
    b = a.filter(F.col("rank").between(2, 4)).withColumn("rank", F.col("rank") - 1)
    u = R.first_of([a.filter("rank <= 3"), b])
    return u.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("list_no", "rank")).alias("rank"))


@query(BM25 + r""", h AS (SELECT * FROM bm WHERE rank <= 10),
c AS (SELECT h.query_id, h.chunk_id, h.score AS fused, round(len(list_intersect(list_distinct(regexp_extract_all(lower(k.text), '[a-z0-9]{2,}')), regexp_extract_all(lower(d.text), '[a-z0-9]{2,}'))) / nullif(len(list_distinct(regexp_extract_all(lower(k.text), '[a-z0-9]{2,}'))), 0), 6) AS score
FROM h JOIN benchmark k ON k.item_id = h.query_id JOIN documents d ON d.doc_id = h.chunk_id)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused DESC, chunk_id) AS INT) AS rank FROM c) WHERE rank <= 5""")
def r15_rerank(spark, sf):
    """Reranking of ten hits by the stand-in scorer."""
    return R.coverage_rerank(lexical(spark, sf).filter("rank <= 10"), query_table(spark, sf), chunk_table(spark, sf))


@query(VECTOR + "SELECT query_id, round(avg(CAST(b.label = a.label AS DOUBLE)), 6) AS precision FROM vt JOIN embeddings a ON a.vec_id = vt.query_id JOIN embeddings b ON b.vec_id = vt.chunk_id GROUP BY query_id")
def r06_label_precision(spark, sf):
    """Share of the 20 nearest with the query's label."""
    e = table(spark, sf, "embeddings")
    j = nearest(spark, sf).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("b")), "chunk_id")
    return j.groupBy("query_id").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("precision"))


HASHED = """, hv AS (SELECT src, id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY src, id)) AS x FROM (
SELECT src, id, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS INT) AS dim, CAST(count(*) AS DOUBLE) AS x FROM (
SELECT 'd' AS src, doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) FROM benchmark) GROUP BY ALL)),
hs AS (SELECT q.id AS query_id, d.id AS chunk_id, round(sum(q.x * d.x), 6) AS score FROM hv q JOIN hv d ON q.dim = d.dim AND q.src = 'q' AND d.src = 'd' GROUP BY ALL),
dv AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM hs) WHERE rank <= 20)
"""
FUSED = BM25 + HASHED + """, bo AS (SELECT bm.query_id, bm.chunk_id, bm.score + CASE WHEN len(list_filter(string_split_regex(lower(k.text), '\\s+'), lambda w: w <> '' AND contains(lower(d.source), w))) > 0 THEN 5.0 ELSE 0.0 END AS score
FROM bm JOIN benchmark k ON k.item_id = bm.query_id JOIN documents d ON d.doc_id = bm.chunk_id),
bl AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bo),
fu AS (SELECT query_id, chunk_id, round(sum(1.0 / (120 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM dv UNION ALL SELECT query_id, chunk_id, rank FROM bl) GROUP BY ALL),
f10 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM fu) WHERE rank <= 10)
"""
COVER = """, cv AS (SELECT h.query_id, h.chunk_id, h.score AS fused, len(list_intersect(list_distinct(regexp_extract_all(lower(k.text), '[a-z0-9]{2,}')), regexp_extract_all(lower(d.text), '[a-z0-9]{2,}'))) / nullif(len(list_distinct(regexp_extract_all(lower(k.text), '[a-z0-9]{2,}'))), 0) AS cover
FROM f10 h JOIN benchmark k ON k.item_id = h.query_id JOIN documents d ON d.doc_id = h.chunk_id),
rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cover DESC, fused DESC, chunk_id) AS INT) AS rank FROM cv WHERE cover > LIMIT)
"""


def by_mode(spark, sf, mode: str) -> DataFrame:
    chunks, queries = chunk_table(spark, sf), query_table(spark, sf)
    vectors = R.dense_embedding(chunks, "chunk_id", "text").withColumnRenamed("id", "chunk_id")
    asked = R.dense_embedding(queries, "query_id", "query").withColumnRenamed("id", "query_id")
    return R.retrieve(index_of(spark, sf), vectors, queries, asked, chunks, mode, digits=6)


@query(BM25 + "SELECT query_id, chunk_id, score, rank, 'bm25' AS retriever FROM bm WHERE rank <= 5")
def r09_mode_bm25(spark, sf):
    """The lexical mode."""
    return by_mode(spark, sf, " BM25 ")


@query(BM25 + HASHED + "SELECT query_id, chunk_id, score, rank, 'vector' AS retriever FROM dv WHERE rank <= 5")
def r10_mode_vector(spark, sf):
    """The vector mode."""
    return by_mode(spark, sf, "vector")


@query(BM25 + HASHED + """, u AS (SELECT query_id, chunk_id, score, rank, 'bm25' AS retriever, 0 AS list_no FROM bm WHERE rank <= 3 UNION ALL SELECT query_id, chunk_id, score, rank, 'vector', 1 FROM dv WHERE rank <= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list_no, rank) AS one FROM u)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank) AS INT) AS rank, retriever FROM o WHERE one = 1""")
def r11_mode_balanced(spark, sf):
    """Three lexical and two vector hits, the first list's hit wins, no back-fill."""
    return by_mode(spark, sf, "bm25_vector")


@query(FUSED + "SELECT query_id, chunk_id, score, rank, 'fusion' AS retriever FROM f10 WHERE rank <= 5", digits=9)
def r13_mode_fusion(spark, sf):
    """Boosted lexical and vector lists fused."""
    return by_mode(spark, sf, "bm25_vector_fusion")


@query(FUSED + COVER.replace("LIMIT", "-1") + "SELECT query_id, chunk_id, round(cover, 6) AS score, rank, 'fusion' AS retriever FROM rr WHERE rank <= 5")
def r14_full_pipeline(spark, sf):
    """Lists fused and reranked, also for an unknown mode."""
    return by_mode(spark, sf, "anything")


@query(FUSED + COVER.replace("LIMIT", "0.3") + "SELECT query_id, chunk_id, round(cover, 6) AS score, rank FROM rr WHERE rank <= 5")
def r16_rerank_threshold(spark, sf):
    """Reranking that drops hits at or under a threshold."""
    lists = [R.vector_top(*(R.dense_embedding(df, i, t).withColumnRenamed("id", i) for df, i, t in ((chunk_table(spark, sf), "chunk_id", "text"), (query_table(spark, sf), "query_id", "query"))), digits=6), R.boosted(lexical(spark, sf), query_table(spark, sf), chunk_table(spark, sf))]
    fused = R.reciprocal_fusion(lists, digits=9)
    return R.coverage_rerank(fused, query_table(spark, sf), chunk_table(spark, sf), threshold=0.3)


@query(r"""WITH h AS (SELECT doc_id, text, source, list_extract(['PDF_manual', 'Video_Transcript', 'GitHub', 'other', 'pdf_video', ''], CAST(doc_id % 6 + 1 AS INT)) AS st, doc_id % 4 AS v FROM documents),
k AS (SELECT *, CASE WHEN lower(st) LIKE '%pdf%' THEN 'pdf' WHEN lower(st) LIKE '%video%' THEN 'video' WHEN lower(st) LIKE '%github%' THEN 'markdown' ELSE 'text' END AS kind FROM h)
SELECT doc_id AS chunk_id, kind AS source_type, CASE kind WHEN 'markdown' THEN 'md/' || doc_id WHEN 'video' THEN NULL ELSE 'src/' || doc_id END AS source_url,
CASE WHEN kind = 'pdf' THEN 'man' || doc_id END AS pdf_id, CASE WHEN kind = 'pdf' THEN CASE v WHEN 0 THEN 12 WHEN 1 THEN 1 WHEN 2 THEN 34 ELSE 1 END END AS page_number, CASE WHEN kind = 'pdf' THEN CASE v WHEN 0 THEN 90 ELSE 1 END END AS total_pages,
CASE kind WHEN 'video' THEN 'film' WHEN 'markdown' THEN CASE v WHEN 0 THEN 'f.md' ELSE 'm' END ELSE source END AS title,
CASE kind WHEN 'video' THEN CASE v WHEN 0 THEN 'intro' WHEN 1 THEN '1:02:03' WHEN 2 THEN '4:05' ELSE 'video description' END WHEN 'markdown' THEN source END AS section,
CASE WHEN kind = 'video' THEN 'watch' END AS video_link, CASE WHEN kind = 'video' THEN CASE v WHEN 1 THEN '1:02:03' WHEN 2 THEN '4:05' END END AS timestamp,
CAST(CASE WHEN kind = 'video' THEN CASE v WHEN 1 THEN 3723 WHEN 2 THEN 245 END END AS DOUBLE) AS second_offset, left(text, 1000) AS content FROM k""")
def r18_normalised_hits(spark, sf):
    """Hits of all source types with set, unset and malformed fields."""
    case = lambda *cs: F.element_at(F.array(*(F.lit(c).cast("string") for c in cs)), F.pmod("doc_id", F.lit(len(cs))).cast("int") + 1)
    key = F.col("doc_id").cast("string")
    own = {
        "source_type": case("PDF_manual", "Video_Transcript", "GitHub", "other", "pdf_video", ""), "source_url": F.concat(F.lit("src/"), key), "pdf_name": F.concat(F.lit("man"), key, F.lit(".pdf")), "section_title": F.col("source"),
        "page_start": case("12", "x", "", None), "page": case("7", None, "34", None), "total_pages": case("90", "", None, "many"), "video_title": F.lit("film"), "chapter_title": case("intro", "", None, None),
        "start_time": case(None, "1:02:03", "4:05", None), "url": F.lit("watch"), "markdown_file": case("f.md", "", None, None), "md_name": F.lit("m"), "md_url": F.concat(F.lit("md/"), key),
    }
    hits = table(spark, sf, "documents").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("chunk_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"), "text", *(own[c].alias(c) for c in R.HIT_KEYS))
    return R.normalised_hits(hits).drop("query_id", "rank", "score")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'pdf' WHEN p_size % 3 = 0 THEN 'document' ELSE p_type END AS source_type, CASE p_size % 3 WHEN 0 THEN '5' WHEN 1 THEN '6' END AS page FROM part")
def r19_node_metadata(spark, sf):
    """The plainer resolver of metadata."""
    n = F.col("p_size")
    m = F.struct(
        F.when(n % 2 == 0, "a.pdf").otherwise("").alias("pdf_name"),
        F.when(n % 3 != 0, F.col("p_type")).alias("source_type"),
        F.when(n % 3 == 0, "5").alias("page_start"),
        F.when(n % 3 == 1, "6").otherwise("").alias("page"),
        F.lit(None).cast("string").alias("page_number"),
        F.lit("u").alias("source_url"),
    )
    return table(spark, sf, "part").select("p_partkey", R.node_metadata(m).alias("x")).select("p_partkey", "x.source_type", "x.page")


@query("""SELECT c_custkey, 'Rank ' || c_custkey || ' | ' || CASE WHEN c_custkey % 2 = 0 THEN 'pdf' ELSE 'text' END || ' | ' || CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN length(c_name || c_name || c_name) > 40 THEN left(c_name || c_name || c_name, 40) || '...' ELSE c_name || c_name || c_name END
|| ' | ' || CASE WHEN c_custkey % 3 = 0 THEN 'sec' WHEN c_custkey % 3 = 1 THEN '1:02' ELSE c_name || c_name || c_name END AS label FROM customer""")
def u05_labels(spark, sf):
    """Labels of a list of hits."""
    n = F.col("c_custkey")
    hits = table(spark, sf, "customer").select(
        "c_custkey",
        n.alias("rank"),
        F.when(n % 2 == 0, "pdf").otherwise("text").alias("source_type"),
        F.when(n % 2 == 0, F.col("c_name")).alias("pdf_id"),
        F.concat("c_name", "c_name", "c_name").alias("title"),
        F.when(n % 3 == 0, "sec").alias("section"),
        F.when(n % 3 == 1, "1:02").alias("timestamp"),
    )
    return hits.select("c_custkey", R.hit_label().alias("label"))


@query("""WITH f AS (SELECT s_suppkey, s_name || CASE s_suppkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' ELSE '.txt' END AS name FROM supplier) SELECT s_suppkey, name, name = (SELECT max(name) FROM f WHERE s_suppkey % 3 < 2) AS chosen FROM f WHERE s_suppkey % 3 < 2""")
def s09_pdf_files(spark, sf):
    """Page sources by their ending, and one by its name in any case."""
    f = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.element_at(F.array(F.lit(".PDF"), F.lit(".pdf"), F.lit(".txt")), F.pmod("s_suppkey", F.lit(3)).cast("int") + 1)).alias("name"))
    target = S.pdf_files(f).agg(F.max("name")).first()[0]
    one = S.pdf_files(f, target.upper()).select("s_suppkey", F.lit(True).alias("chosen"))
    return S.pdf_files(f).join(one, "s_suppkey", "left").select("s_suppkey", "name", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query("SELECT p_partkey AS video_id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS description, p_brand AS author, CAST(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS INT) AS chapters FROM part")
def s06_video_info(spark, sf):
    """Fields of fetched videos; null descriptions and chapters are empty."""
    one = F.array(F.struct(F.lit(0.0).alias("start_time"), F.lit("c").alias("title"), F.lit(1.0).alias("end_time")))
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.lit("u").alias("url"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("description"),
        F.col("p_brand").alias("uploader"),
        F.lit("20250101").alias("upload_date"),
        F.lit(3).alias("duration"),
        F.when(F.col("p_size") % 3 == 0, one).alias("chapters"),
    )
    return S.video_info(raw).select("video_id", "title", "description", "author", F.size("chapters").alias("chapters"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def r05_new_rows(spark, sf):
    """Rows that a store lacks."""
    return R.new_rows(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").filter("l_linenumber = 2").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


# Text functions.


@query("SELECT doc_id, md5(concat_ws('_', source, CAST(n_chars AS VARCHAR), text)) AS chunk_id, md5(CASE doc_id % 4 WHEN 0 THEN 'd' || doc_id WHEN 1 THEN source WHEN 2 THEN 'f' ELSE '' END || '::' || trim(text, E' \\t\\n\\r\\x0b\\x0c')) AS node_key FROM documents")
def t34_ids(spark, sf):
    """Content ids and fusion keys."""
    at = lambda k, c, other=None: F.when(F.pmod("doc_id", F.lit(4)) == k, c).otherwise(other)
    return table(spark, sf, "documents").select("doc_id", T.chunk_id(F.col("source"), F.col("n_chars"), F.col("text")).alias("chunk_id"), T.node_key(at(0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))), at(1, F.col("source"), ""), F.col("text"), at(2, F.lit("f"))).alias("node_key"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INT) AS tokens, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) + 2 AS INT) AS with_specials FROM documents")
def t11_token_count(spark, sf):
    """Token counts by the stand-in tokenizer."""
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).cast("int").alias("tokens"), T.token_count(F.col("text"), 2).cast("int").alias("with_specials"))


@query("SELECT p_partkey, upper(trim(regexp_replace(p_name || ' (' || p_type || ')', '[^A-Za-z0-9]+', '_', 'g'), '_')) || '_PAGE_' || p_size AS section_id, '[IMAGE_PLACEHOLDER_' || upper(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) || ']' AS tag FROM part")
def t14_section_id(spark, sf):
    """Slugs, section ids and placeholders."""
    title = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", T.section_id(title, F.col("p_size")).alias("section_id"), T.placeholder(T.slug(F.col("p_name"))).alias("tag"))


@query("SELECT event_id, CAST(floor(floor(value) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS stamp, floor(value) AS back FROM (SELECT event_id, abs(value) * 100 AS value FROM events)")
def t23_timestamps(spark, sf):
    """Seconds to m:ss and back."""
    s = T.minutes(F.abs("value") * 100)
    return table(spark, sf, "events").select("event_id", s.alias("stamp")).withColumn("back", T.seconds(F.col("stamp")))


@query(r"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN regexp_extract(url, '([^/]*)$', 1) WHEN 1 THEN 'a/b' || page_id WHEN 2 THEN 'watch?v=x' WHEN 3 THEN 's' || page_id || '/t' WHEN 4 THEN NULL ELSE 'k-' || page_id END AS video_id,
left(regexp_replace(trim(regexp_replace(url, '[^\w\s-]', '', 'g')), '\s+', '_', 'g'), 80) AS file_name FROM pages""")
def t17_video_id(spark, sf):
    """Video ids and file names from urls."""
    key = F.col("page_id").cast("string")
    links = [F.col("url"), F.concat(F.lit("https://WWW.youtube.com/watch?t=1&v=a%2Fb"), key), F.concat(F.lit("https://notyoutube.com/"), key, F.lit("/watch?v=x")),
             F.concat(F.lit("https://youtu.be//s"), key, F.lit("/t?si=1")), F.lit("https://youtube.com/watch?t=1&v="), F.concat(F.lit("https://youtube.com/watch?v=k-"), key, F.lit("#v"))]
    link = F.element_at(F.array(*links), F.pmod("page_id", F.lit(6)).cast("int") + 1)
    return table(spark, sf, "pages").select("page_id", T.video_id(link).alias("video_id"), T.file_name(F.col("url")).alias("file_name"))


@query(r"""SELECT doc_id, CASE WHEN length(l) > 120 THEN array_to_string(list_slice(string_split_regex(l, '\s+'), 1, 15), ' ') || '...' WHEN l = '' THEN NULL ELSE l END AS title
FROM (SELECT doc_id, trim(string_split(trim(text, E' \t\n\r\x0b\x0c'), E'\n')[1], E' \t\n\r\x0b\x0c') AS l FROM documents)""")
def t25_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_line_title(F.col("text")).alias("title"))


@query(r"""SELECT doc_id, trim(array_to_string(list_filter(string_split(text, E'\n'), lambda l: NOT regexp_matches(l, '^\d+\s*\|\s*P\s*a\s*g\s*e') AND NOT contains(l, 'License')), E'\n'), E' \t\n\r\x0b\x0c') AS text FROM documents""")
def t01_clean_page(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_page(F.col("text"), ("License",)).alias("text"))


UPPER_LINE = r"upper(line) = line AND lower(line) <> line AND len(string_split_regex(line, '\s+')) >= 2"


@query(rf"""WITH texts AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN E'  FIRST PART \n\nSECOND PART\nA_B PART = 1\n' || text || E'\n LAST PART' ELSE text END AS text FROM documents),
l AS (SELECT doc_id, generate_subscripts(string_split(text, E'\n'), 1) AS line_no, trim(unnest(string_split(text, E'\n')), E' \t\r\x0b\x0c') AS line FROM texts),
u AS (SELECT *, {UPPER_LINE} AS up FROM l WHERE line <> ''),
r AS (SELECT *, sum(CASE WHEN up AND before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT *, coalesce(lag(up) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS before FROM u)),
g AS (SELECT doc_id, min(line_no) AS line_no, string_agg(line, ': ' ORDER BY line_no) AS line FROM r GROUP BY doc_id, run),
k AS (SELECT *, {UPPER_LINE} AND NOT regexp_matches(line, '[=_<>]') AS head FROM g),
n AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM k)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, max(line || ' (page 1)') FILTER (WHERE head) AS title, coalesce(string_agg(line, E'\n' ORDER BY line_no) FILTER (WHERE NOT head), '') AS content FROM n GROUP BY doc_id, section_no""")
def t03_sections(spark, sf):
    """Sections at capital headings of stripped lines, runs of titles merged."""
    text = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("  FIRST PART \n\nSECOND PART\nA_B PART = 1\n"), "text", F.lit("\n LAST PART"))).otherwise(F.col("text"))
    return T.sections(table(spark, sf, "documents").select("doc_id", text.alias("text")), "doc_id", "text", F.lit(1))


@query("""SELECT s.s_suppkey, n.n_name AS base FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'plain' ELSE 'own_' || s_nationkey || '__a__b.md' END AS name FROM supplier) s
JOIN nation n ON s.name LIKE 'own\\_%' ESCAPE '\\' AND split_part(s.name, '__', 1) = 'own_' || n.n_nationkey WHERE n.n_nationkey < 20""")
def t26_repo_lookup(spark, sf):
    """Files by the prefix of their name; unknown prefixes and names without one are skipped."""
    name = F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "plain").otherwise(F.concat(F.lit("own_"), F.col("s_nationkey").cast("string"), F.lit("__a__b.md")))
    repos = table(spark, sf, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("own/"), F.col("n_nationkey").cast("string")).alias("repo"), F.col("n_name").alias("base"))
    return T.repo_lookup(table(spark, sf, "supplier").select("s_suppkey", name.alias("name")), repos, "name").select("s_suppkey", "base")


@query("""SELECT s.s_suppkey, n.url AS source_url, n.n_name AS source_name FROM supplier s LEFT JOIN (SELECT n_regionkey, min(n_name) AS n_name, 'u/' || min(n_name) AS url FROM nation WHERE n_regionkey < 3 GROUP BY n_regionkey) n ON s.s_nationkey % 5 = n.n_regionkey""")
def t31_source_lookup(spark, sf):
    """The first source of a name; null where there is none."""
    known = table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_regionkey").alias("name"), F.concat(F.lit("u/"), "n_name").alias("source_url"), F.col("n_name").alias("source_name"))
    mine = table(spark, sf, "supplier").select("s_suppkey", F.pmod("s_nationkey", F.lit(5)).alias("name"))
    return T.source_lookup(mine, known, "name").select("s_suppkey", "source_url", "source_name")


@query("""SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN turn + 0.5 END, lead(CAST(turn AS DOUBLE)) OVER (PARTITION BY conv_id ORDER BY turn), 99.0) AS end_time FROM conversations""")
def t20_chapter_ends(spark, sf):
    """A chapter's own end, else the next one's start, else the whole duration."""
    start = F.col("turn").cast("double")
    own = F.when(F.pmod("turn", F.lit(3)) == 0, start + 0.5)
    following = F.lead(start).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", C.chapter_ends(own, following, F.lit(99.0)).alias("end_time"))


@query("""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id AS DOUBLE) WHEN conv_id % 3 = 1 THEN max(turn) + 1.5 ELSE 0.0 END AS total,
CASE WHEN conv_id % 2 = 0 THEN 'named' END AS title, CASE WHEN conv_id % 2 = 0 THEN 7.0 WHEN conv_id % 3 = 0 THEN CAST(conv_id AS DOUBLE) WHEN conv_id % 3 = 1 THEN max(turn) + 1.5 ELSE 0.0 END AS end_time FROM conversations GROUP BY conv_id""")
def t21_durations(spark, sf):
    """Whole durations, and one untitled chapter where there is none."""
    seg = F.sort_array(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), F.lit(1.5).alias("duration"))))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(seg.alias("segments"))
    g = g.withColumn("segments", F.when(F.pmod("conv_id", F.lit(3)) == 1, F.col("segments")).otherwise(F.slice("segments", 1, 0)))
    total = C.total_duration(F.when(F.pmod("conv_id", F.lit(3)) == 0, F.col("conv_id").cast("double")), F.col("segments"))
    named = F.array(F.struct(F.lit(0.0).alias("start_time"), F.lit("named").alias("title"), F.lit(7.0).alias("end_time"), F.lit("t").alias("text")))
    chapters = F.when(F.pmod("conv_id", F.lit(2)) == 0, named).otherwise(F.slice(named, 1, 0))
    made = g.withColumn("total", total).withColumn("chapters", C.with_pseudo_chapter(chapters, F.col("total"), F.lit("all")))
    return made.select("conv_id", "total", F.col("chapters")[0]["title"].alias("title"), F.col("chapters")[0]["end_time"].alias("end_time"))


@query(r"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || E'\n\nAssociated image descriptions:\n' || p_type ELSE p_name || E'\n\nAssociated image descriptions:\n' || p_type || E'\n' || p_brand END AS text FROM part""")
def t29_descriptions(spark, sf):
    """Image descriptions after a section's text."""
    some = F.slice(F.array("p_type", "p_brand"), F.lit(1), F.pmod("p_size", F.lit(3)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.with_descriptions(F.col("p_name"), some).alias("text"))


@query("SELECT doc_id, n AS token_length FROM (SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INT) AS n FROM documents) WHERE n > 512")
def t30_over_long(spark, sf):
    """Sections of over 512 tokens."""
    return C.over_long(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "token_length")


ASOF = """
WITH s AS (SELECT conv_id, CAST(turn AS VARCHAR) AS section_id, turn * 2 AS page FROM conversations), p AS (SELECT conv_id, turn * 3 AS image_page FROM conversations)
SELECT s.conv_id, s.section_id, s.page, coalesce(max(image_page) FILTER (WHERE image_page <= page), min(image_page) FILTER (WHERE image_page > page)) AS nearest
FROM s LEFT JOIN p ON s.conv_id = p.conv_id GROUP BY ALL"""


@query(ASOF)
def t28b_nearest_page(spark, sf):
    """As-of lookup: exact or earlier, else later."""
    c = table(spark, sf, "conversations")
    return T.nearest_page(c.select("conv_id", F.col("turn").cast("string").alias("section_id"), (F.col("turn") * 2).alias("page")), c.select("conv_id", (F.col("turn") * 3).alias("image_page")), "conv_id")


@query("""
WITH seg AS (SELECT user_id % 50 AS u, epoch(ts) AS start, 30.0 AS duration, event_type AS text FROM events),
b AS (SELECT u, min(start) AS t0, max(start) AS t1 FROM seg GROUP BY u),
ch AS (SELECT u, c AS chapter, t0 + (t1 - t0) * c / 4 AS start_time, t0 + (t1 - t0) * (c + 1) / 4 AS end_time FROM b, (SELECT unnest(range(4)) AS c))
SELECT ch.u, ch.chapter, round(ch.start_time, 6) AS start_time, round(ch.end_time, 6) AS end_time, coalesce(string_agg(text, ' ' ORDER BY seg.start, text), '') AS text
FROM ch LEFT JOIN seg ON ch.u = seg.u AND seg.start + duration > ch.start_time AND seg.start < ch.end_time GROUP BY ALL""")
def t19_interval_collect(spark, sf):
    """Text of all segments that overlap each interval."""
    ev = table(spark, sf, "events").select(F.pmod("user_id", F.lit(50)).alias("u"), F.col("ts").cast("timestamp").cast("double").alias("start"), F.lit(30.0).alias("duration"), F.col("event_type").alias("text"))
    b = ev.groupBy("u").agg(F.min("start").alias("t0"), F.max("start").alias("t1"))
    ch = b.withColumn("chapter", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    at = lambda c: F.col("t0") + (F.col("t1") - F.col("t0")) * c / 4
    return C.collect_between(ch.select("u", "chapter", at(F.col("chapter")).alias("start_time"), at(F.col("chapter") + 1).alias("end_time")), ev, "u")


@query((
    r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS node, t AS text FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS t "
    r"FROM (SELECT doc_id, string_split(regexp_replace(text, '(^|\n)(#{1,6}\s)', E'\\1\x01\\2', 'g'), E'\x01') AS p FROM documents)) WHERE trim(t, E' \t\n\r\x0b\x0c') <> ''"
))
def c01_header_nodes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(C.header_nodes(F.col("text"))).alias("node", "text"))


TOKENS = "CAST(len(regexp_extract_all(lower({c}), '[a-z0-9]+')) AS BIGINT)"


@query(rf"""WITH long AS (SELECT doc_id, text FROM documents WHERE {TOKENS.format(c='text')} > 500),
split AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', E'\\1\x01', 'g'), E'\x01') AS parts FROM long),
sents AS (SELECT doc_id, i, parts[i] AS s FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split) WHERE trim(parts[i], E' \t\n\r\x0b\x0c') <> ''),
worded AS (SELECT doc_id, i, flatten(list_transform(regexp_extract_all(s, '\S+'), lambda w: CASE WHEN {TOKENS.format(c='w')} > 500 THEN regexp_extract_all(w, '[^A-Za-z0-9]*(?:[A-Za-z0-9]+[^A-Za-z0-9]*){{1,500}}') ELSE [w] END)) AS ws FROM sents WHERE {TOKENS.format(c='s')} > 500),
greedy AS (SELECT doc_id, i, list_reduce(list_transform(ws, lambda w: {{'done': CAST([] AS VARCHAR[]), 'now': w, 'n': {TOKENS.format(c='w')}}}),
  lambda a, x: CASE WHEN a.n + x.n > 500 THEN {{'done': list_append(a.done, a.now), 'now': x.now, 'n': x.n}} ELSE {{'done': a.done, 'now': a.now || ' ' || x.now, 'n': a.n + x.n}} END) AS g FROM worded),
pieces AS (SELECT doc_id, i, 0 AS j, s AS p FROM sents WHERE {TOKENS.format(c='s')} <= 500 UNION ALL SELECT doc_id, i, unnest(range(len(g.done) + 1)), unnest(list_append(g.done, g.now)) FROM greedy),
lists AS (SELECT doc_id, list(p ORDER BY i, j) AS ps FROM pieces GROUP BY doc_id),
packed AS (SELECT doc_id, list_reduce(list_transform(ps, lambda p: {{'done': CAST([] AS VARCHAR[]), 'now': p, 'n': {TOKENS.format(c='p')}, 'last': p, 'last_n': {TOKENS.format(c='p')}}}),
  lambda a, x: CASE WHEN a.n > 0 AND a.n + x.n > 500 AND a.last_n <= 50 AND a.last_n + x.n <= 500 THEN {{'done': list_append(a.done, a.now), 'now': a.last || ' ' || x.now, 'n': a.last_n + x.n, 'last': x.last, 'last_n': x.last_n}}
    WHEN a.n > 0 AND a.n + x.n > 500 THEN {{'done': list_append(a.done, a.now), 'now': x.now, 'n': x.n, 'last': x.last, 'last_n': x.last_n}}
    ELSE {{'done': a.done, 'now': a.now || ' ' || x.now, 'n': a.n + x.n, 'last': x.last, 'last_n': x.last_n}} END) AS r FROM lists),
parts AS (SELECT doc_id, unnest(range(len(r.done) + 1)) AS part, unnest(list_append(r.done, r.now)) AS t, true AS long FROM packed UNION ALL SELECT doc_id, 0, text, false FROM documents WHERE {TOKENS.format(c='text')} <= 500)
SELECT doc_id, CAST(part AS INT) AS part, CASE WHEN long THEN doc_id || '_part' || (part + 1) END AS sub_section_id, CAST({TOKENS.format(c='t')} AS INT) AS token_length, md5(t) AS text_md5 FROM parts""")
def c03_keep_or_split(spark, sf):
    """Long texts cut by sentences, over-long sentences by words, others kept."""
    return C.keep_or_split(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "part", "sub_section_id", "token_length", F.md5("text").alias("text_md5"))


@query(r"""WITH g AS (SELECT conv_id, list(text ORDER BY turn, text) AS texts, list(CAST(turn AS DOUBLE) ORDER BY turn, text) AS turns FROM conversations WHERE trim(text, E' \t\n\r\x0b\x0c') <> '' GROUP BY conv_id),
s AS (SELECT conv_id, list_transform(list_zip(texts, turns), lambda p: {'done': CAST([] AS STRUCT(t VARCHAR, s DOUBLE, e DOUBLE)[]), 't': p[1], 'n': CAST(len(regexp_extract_all(lower(p[1]), '[a-z0-9]+')) AS BIGINT), 's': p[2], 'e': p[2] + 1.0}) AS xs FROM g),
r AS (SELECT conv_id, list_reduce(xs, lambda a, x: CASE WHEN a.n + x.n > 66 THEN {'done': list_append(a.done, {'t': a.t, 's': a.s, 'e': a.e}), 't': x.t, 'n': x.n, 's': x.s, 'e': x.e} ELSE {'done': a.done, 't': a.t || ' ' || x.t, 'n': a.n + x.n, 's': a.s, 'e': x.e} END) AS a FROM s),
u AS (SELECT conv_id, list_append(a.done, {'t': a.t, 's': a.s, 'e': a.e}) AS parts FROM r)
SELECT conv_id, CAST(k - 1 AS INT) AS part, parts[k].s AS start, parts[k].e AS "end", md5(parts[k].t) AS text_md5 FROM (SELECT conv_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM u)""")
def c07_pack_segments(spark, sf):
    """Turns of a conversation as timed segments, packed greedily."""
    seg = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("text"), x["turn"].cast("double").alias("start"), F.lit(1.0).alias("duration")))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(seg.alias("segments"))
    return g.select("conv_id", F.posexplode(C.pack_segments(F.col("segments"), 60)).alias("part", "g")).select("conv_id", "part", F.col("g.start").alias("start"), F.col("g.end").alias("end"), F.md5("g.text").alias("text_md5"))


@query("SELECT count(t) AS n, min(t) AS min, max(t) AS max, round(avg(t), 6) AS mean, CAST(sum(t) AS BIGINT) AS total FROM (SELECT CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INT) AS t FROM documents)")
def c09_token_stats(spark, sf):
    return C.token_stats(table(spark, sf, "documents").withColumn("token_length", T.token_count(F.col("text")).cast("int")))


@query(r"SELECT conv_id, array_to_string(list(role || ': ' || text ORDER BY turn), E'\n\n') AS pages FROM conversations GROUP BY conv_id")
def s10_ordered_pages(spark, sf):
    """Rows of a file joined in order."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("page_idx"), F.concat("role", F.lit(": "), "text").alias("text"))
    return S.ordered_pages(c).select(F.col("file").alias("conv_id"), F.array_join("pages", "\n\n").alias("pages"))


@query(BM25 + r""", h AS (SELECT bm.query_id, '[' || bm.rank || '] ' || d.source || ' (sec:-)' || E'\n' || left(trim(left(d.text, 1000)), 800) AS block, bm.rank FROM bm JOIN documents d ON d.doc_id = bm.chunk_id WHERE bm.rank <= 5),
c AS (SELECT query_id, string_agg(block, E'\n\n' ORDER BY rank) AS context FROM h GROUP BY query_id)
SELECT k.item_id AS query_id, k.text AS query, CASE WHEN c.context IS NULL THEN 'No documents were found; answer from general knowledge and say so.' || E'\n\nQuestion: ' || k.text || E'\nAnswer:'
  ELSE 'Answer the question from the context only.' || E'\n\nContext:\n' || c.context || E'\n\nQuestion: ' || k.text || E'\nAnswer:' END AS prompt, c.context IS NULL AS without_context
FROM benchmark k LEFT JOIN c ON c.query_id = k.item_id""")
def g02_prompts(spark, sf):
    """Context blocks and prompts of retrieved hits."""
    hits = lexical(spark, sf).filter("rank <= 5").join(chunk_table(spark, sf), "chunk_id")
    known = {"source_type": F.lit("markdown"), "markdown_file": F.col("title")}
    wide = hits.select("query_id", "chunk_id", "rank", "score", "text", *(known.get(c, F.lit(None).cast("string")).alias(c) for c in R.HIT_KEYS))
    return R.prompts(query_table(spark, sf), R.context_block(R.normalised_hits(wide)))


@query(r"""SELECT p_partkey, t.title || '|' || t.page || '|' || p_type AS sections FROM (
SELECT p_partkey, p_type, unnest([{'title': p_name, 'page': p_size}, {'title': p_name || '-IMAGE', 'page': p_size + 1}]) AS t FROM part)""")
def t10_markdown_sections(spark, sf):
    """Headed Markdown made (T07) and split again at its page headings."""
    p = table(spark, sf, "part")
    head = lambda t, n: F.struct(F.concat(t, F.lit(" (page "), n.cast("string"), F.lit(")")).alias("title"), F.col("p_type").alias("content"))
    md = T.markdown(F.array(head(F.col("p_name"), F.col("p_size")), head(F.concat("p_name", F.lit("-IMAGE")), F.col("p_size") + 1)))
    s = p.select("p_partkey", F.explode(T.markdown_sections(md)).alias("s"))
    return s.select("p_partkey", F.concat_ws("|", "s.title", F.col("s.page").cast("string"), "s.text").alias("sections"))


@query(r"""SELECT p_partkey, '# ' || p_name || E'\n' || p_type || E'\n\n# ' || p_name || E'-IMAGE DESCRIPTIONS\n[IMAGE_PLACEHOLDER_' || tag || ']' AS md, '[IMAGE_PLACEHOLDER_' || tag || ']' AS found,
CASE WHEN contains(p_name || p_type, 'STEEL') THEN substr(p_name || p_type, strpos(p_name || p_type, 'STEEL')) ELSE p_name || p_type END AS cut
FROM (SELECT *, upper(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS tag FROM part)""")
def t08_image_headings(spark, sf):
    """Image headings after sections, their placeholders, text from a marker on."""
    md = T.markdown_with_images(F.array(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("content"))))
    return table(spark, sf, "part").select("p_partkey", md.alias("md"), F.element_at(T.placeholders(F.lower(md)), 1).alias("found"), T.from_marker(F.concat("p_name", "p_type"), "STEEL").alias("cut"))


@query(r"""SELECT o_orderkey, CASE WHEN contains(o_orderpriority, ' ') THEN 'MAIN TITLE: SUB TITLE: ' || o_orderpriority || ': NEXT PART' ELSE 'MAIN TITLE: SUB TITLE' || E'\n' || o_orderpriority || E'\nNEXT PART' END AS merged,
CASE o_orderkey % 4 WHEN 0 THEN '$$R^2 = \frac{SS_M}{SS_T}$$' WHEN 1 THEN '$$F = \frac{Mean\ SS_M}{Mean\ SS_R}$$'
WHEN 2 THEN '$$t = \frac{\text{mean group 1 - mean group 2}}{\text{standard error of mean differences}}$$' ELSE 'so F = ' || o_orderstatus END || E'\nplain cafe ' || o_orderkey AS equations,
CASE o_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN E'text\n\n' || o_orderkey || E'\nword' ELSE E'text\n\n \t' || array_to_string(list_transform(range(7), lambda i: CAST(i AS VARCHAR)), E'\n') END AS tables FROM orders""")
def t02_lines(spark, sf):
    """Title runs merged, equations rewritten, numeric tables dropped."""
    o, nl = table(spark, sf, "orders"), F.lit("\n")
    key = F.col("o_orderkey").cast("string")
    case = lambda n, *cs: F.element_at(F.array(*cs), F.pmod("o_orderkey", F.lit(n)).cast("int") + 1)
    # Seven lines that repeat go; two lines, and seven that do not repeat, stay.
    numbers = F.concat(F.lit("text\n\n"), F.array_join(F.array_repeat(F.concat(F.lit(" "), key), 7), "\n"), F.lit("\n\n  \n "))
    words = F.concat(F.lit("text\n\n"), key, F.lit("\nword"))
    several = F.concat(F.lit("text\n\n \t"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: i.cast("string")), "\n"))
    return o.select(
        "o_orderkey",
        T.merge_upper_titles(F.concat(F.lit("MAIN TITLE\nSUB TITLE\n"), "o_orderpriority", nl, F.lit("NEXT PART"))).alias("merged"),
        T.rewrite_equations(F.concat(case(4, F.lit(" r² = 1, "), F.lit("f= "), F.lit("T – = "), F.lit("so F = ")), "o_orderstatus", F.lit("\n\n  \n plain café "), key)).alias("equations"),
        T.drop_numeric_tables(case(3, numbers, words, several)).alias("tables"),
    )


@query("SELECT s_suppkey, 'name=' || s_name || CASE WHEN s_nationkey > 9 THEN ';nation=' || s_nationkey ELSE '' END AS kept, 'a=x, y;name=' || s_name AS flat, CASE WHEN s_nationkey > 9 THEN CAST(s_nationkey AS VARCHAR) ELSE s_name END AS first_set FROM supplier")
def t16_metadata(spark, sf):
    """Empty entries dropped, values flattened, first set value."""
    n = F.when(F.col("s_nationkey") > 9, F.col("s_nationkey").cast("string")).otherwise("")
    show = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    flat = T.flat_metadata(F.create_map(F.lit("name"), F.col("s_name"), F.lit("a"), F.lit('["x","y"]'), F.lit("none"), F.lit(None).cast("string")))
    return table(spark, sf, "supplier").select("s_suppkey", show(T.drop_empty(F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), n, F.lit("none"), F.lit(None).cast("string")))).alias("kept"), show(flat).alias("flat"), T.or_else(n, F.col("s_name")).alias("first_set"))


@query(r"""WITH l AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN ' ' || left(text, 40) || '? ' WHEN 1 THEN list_extract(['🧪', '📚', '⚙️', '💡', '❓', '🔹'], CAST(conv_id % 6 + 1 AS INT)) || ' why?' WHEN 2 THEN '' ELSE text END AS line FROM conversations)
SELECT 'q_' || row_number() OVER (ORDER BY conv_id, turn, text) AS id, trim(line) AS query FROM l WHERE ends_with(trim(line), '?') AND NOT regexp_matches(trim(line), '^(🧪|📚|⚙️|💡|❓)')""")
def t36_questions(spark, sf):
    """Question lines filtered and numbered."""
    marks = F.element_at(F.array(*(F.lit(x) for x in ("🧪", "📚", "⚙️", "💡", "❓", "🔹"))), F.pmod("conv_id", F.lit(6)).cast("int") + 1)
    forms = [F.concat(F.lit(" "), F.left("text", F.lit(40)), F.lit("? ")), F.concat(marks, F.lit(" why?")), F.lit(""), F.col("text")]
    line = F.element_at(F.array(*forms), F.pmod("turn", F.lit(4)).cast("int") + 1)
    rows = table(spark, sf, "conversations").withColumn("line", line).filter(T.is_question(F.col("line"))).withColumn("o", F.struct("conv_id", "turn", "text"))
    return S.question_template(rows, "o", "line").select("id", "query")


@query(r"SELECT page_id, replace(replace(replace('https://github.com/o/r/tree/' || page_id, '/tree/', '/blob/'), 'https://github.com/', 'https://raw.githubusercontent.com/'), '/blob/', '/') AS raw, url || '#page=' || page_id AS page FROM pages")
def t38_url_rewrites(spark, sf):
    p = F.col("page_id").cast("string")
    return table(spark, sf, "pages").select("page_id", T.raw_url(F.concat(F.lit("https://github.com/o/r/tree/"), p)).alias("raw"), T.page_url(F.col("url"), F.col("page_id")).alias("page"))


@query("SELECT p_partkey, replace(p_brand, '/', '_') || '__' || name AS local_name FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'a_nl.md' WHEN p_size % 3 = 1 THEN p_type || '.md' ELSE p_type END AS name FROM part) WHERE ends_with(name, '.md') AND NOT contains(name, '_nl')")
def s03_listed_files(spark, sf):
    """Markdown files kept and renamed."""
    name = F.when(F.pmod("p_size", F.lit(3)) == 0, "a_nl.md").when(F.pmod("p_size", F.lit(3)) == 1, F.concat("p_type", F.lit(".md"))).otherwise(F.col("p_type"))
    return S.listed_files(table(spark, sf, "part").withColumn("name", name), "name", "p_brand").select("p_partkey", "local_name")


@query((
    "SELECT l_orderkey AS file, page, array_to_string(list(path ORDER BY image_no), ',') AS images FROM (SELECT l_orderkey, l_linenumber % 2 + 1 AS page, l_partkey AS "
    "image_no, CAST(l_partkey AS VARCHAR) AS path, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_partkey, l_suppkey, l_quantity) AS "
    "n FROM lineitem) WHERE n > 2 AND q * 10 >= 150 GROUP BY ALL"
))
def s27_page_images(spark, sf):
    """Images of a page but the first two, large enough."""
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("file"), F.pmod("l_linenumber", F.lit(2)).alias("page"), F.struct("l_partkey", "l_suppkey", "l_quantity").alias("image_no"), F.col("l_partkey").cast("string").alias("path"), (F.col("l_quantity") * 10).alias("width"), F.lit(200).alias("height"))
    return S.page_images(rows).select("file", "page", F.array_join("images", ",").alias("images"))


@query("""WITH p AS (SELECT conv_id, turn * 2 AS page, string_agg(role, ',' ORDER BY role) AS images FROM conversations GROUP BY ALL),
f AS (SELECT conv_id, list(page ORDER BY page) AS pages FROM p GROUP BY conv_id),
l AS (SELECT conv_id, list({'at': turn, 'rest': CAST([] AS BIGINT[]), 'out': CAST([] AS BIGINT[])} ORDER BY turn) AS xs, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, turns, list_reduce(list_prepend({'at': CAST(NULL AS BIGINT), 'rest': pages, 'out': CAST([] AS BIGINT[])}, xs),
  lambda a, x: {'at': x.at, 'rest': list_filter(a.rest, lambda y: y <> coalesce(list_max(list_filter(a.rest, lambda z: z <= x.at)), list_min(a.rest), -1)),
    'out': list_append(a.out, coalesce(list_max(list_filter(a.rest, lambda z: z <= x.at)), list_min(a.rest)))}) AS st FROM l JOIN f USING (conv_id)),
u AS (SELECT conv_id, unnest(turns) AS section_no, unnest(st.out) AS image_page FROM r)
SELECT u.conv_id, CAST(section_no AS INT) AS section_no, image_page, coalesce(images, '') AS images FROM u LEFT JOIN p ON u.conv_id = p.conv_id AND u.image_page = p.page""")
def t28_dispatch_images(spark, sf):
    """Sections take the images of the nearest page that has any left."""
    c = table(spark, sf, "conversations")
    s = c.select("conv_id", F.col("turn").cast("int").alias("section_no"), F.col("turn").alias("page"))
    p = c.groupBy("conv_id", (F.col("turn") * 2).alias("image_page")).agg(F.sort_array(F.collect_list(F.col("role"))).alias("images"))
    return T.dispatch_images(s, p, "conv_id").withColumn("images", F.array_join("images", ","))


@query("SELECT md5(text) AS text_md5, coalesce(lang, '') || '/' || doc_id AS section_title, CAST(n_chars AS INT) AS token_length FROM documents WHERE text IS NOT NULL")
def s13_chunk_files(spark, sf):
    """Documents written as section files and read back."""
    d = table(spark, sf, "documents")
    title = F.concat_ws("/", F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    rows = d.select("source", F.pmod("doc_id", F.lit(50_000)).cast("int").alias("idx"), "text", title.alias("section_title"), F.col("n_chars").cast("int").alias("token_length"))
    path = S.shared_path(spark, "sections")
    S.write_sections(rows, path, 500)
    return S.read_chunks(spark, f"{path}/*/*.json").select(F.md5("text").alias("text_md5"), "meta.section_title", "meta.token_length")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def s18_ingest_once(spark, sf):
    """A stream of documents stored once, though it is read twice."""
    d, store = table(spark, sf, "documents"), S.shared_path(spark, "store")
    for attempt in ("first", "again"):
        I.ingest_once(spark, f"{sf}/documents.parquet*", d.schema, store, S.shared_path(spark, attempt), "doc_id")
    return S.get_or_create(spark, store, d.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).select("doc_id", F.md5("text").alias("text_md5"))


@query(J + f"SELECT qid, mode, success, {R6('mrr', 'recall_gold')} FROM m")
def s21_csv_round_trip(spark, sf):
    """Metrics written as CSV and read with coercion."""
    path = S.shared_path(spark, "csv")
    S.write_csv(metric_rows(spark, sf).select("qid", "mode", "success", "mrr", "recall_gold"), path)
    read = spark.read.option("header", True).csv(path)
    return read.select(F.col("qid").try_cast("long").alias("qid"), "mode", F.col("success").try_cast("int").alias("success"), *(F.col(c).try_cast("double").alias(c) for c in ("mrr", "recall_gold")))


@query(RUN + "SELECT id, retrieved_ids, success_at_k FROM run")
def s26_run_lines(spark, sf):
    """A run written as JSON lines and read back."""
    path = S.shared_path(spark, "run")
    S.write_jsonl(run_results(spark, sf), path)
    return spark.read.schema("id string, retrieved_ids array<string>, success_at_k boolean").json(path).select("id", F.array_join("retrieved_ids", ",").alias("retrieved_ids"), "success_at_k")


@query(J + "SELECT difficulty, mode, count(ndcg) AS n, round(avg(ndcg), 6) AS mean, round(median(ndcg), 6) AS median, CAST(grouping(difficulty, mode) AS BIGINT) AS level FROM m GROUP BY CUBE (difficulty, mode)")
def a10_reference_lines(spark, sf):
    """Means and medians at all levels, the grand ones included."""
    return A.cube_means(metric_rows(spark, sf), "ndcg", median=True)


@query("SELECT 'k' AS missing UNION ALL SELECT 'qid'")
def m15a_missing_columns(spark, sf):
    """Required columns that a table lacks."""
    lacks = M.missing_columns(table(spark, sf, "region"), ["r_name", "qid", "k"])
    return spark.createDataFrame([(c,) for c in lacks], "missing string")
