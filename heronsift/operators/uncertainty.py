"""Intervals, resampling and posterior summaries over metric tables.

Random numbers come from md5 of a label, so they are the same on every engine,
partitioning and rerun.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronsift.operators import posterior as P

#: Fixed value: the 97.5 % quantile of the standard normal distribution.
Z = 1.959963984540054


def md5_uniform(*parts: Column) -> Column:
    """A number above 0 and under 1 from the md5 of the parts joined by ``|``."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def md5_index(n: Column, *parts: Column) -> Column:
    """An index from 0 to n-1."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("long"), n)


def rates(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """n, successes and rate per group."""
    n, k = F.count(F.lit(1)), F.sum(F.col(column).cast("long"))
    return df.groupBy(*by).agg(n.alias("n"), k.alias("successes"), (k / n).alias("rate"))


def wilson(n: Column, rate: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval."""
    zz = Z * Z
    mid = (rate + zz / (2 * n)) / (1 + zz / n)
    half = Z * F.sqrt(rate * (1 - rate) / n + zz / (4 * n * n)) / (1 + zz / n)
    return mid - half, mid + half


def beta_mean(successes: Column, n: Column, a: float = 0.5, b: float = 0.5) -> Column:
    return (successes + a) / (n + a + b)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if not i else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def beta_interval(df: DataFrame, a: float = 0.5, b: float = 0.5) -> DataFrame:
    """Posterior mean and equal-tailed 95 % bounds from ``successes`` and ``n``; a row per group."""

    @F.pandas_udf("struct<lo double, hi double>")
    def bounds(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(beta_quantile(0.025, x + a, m - x + b), beta_quantile(0.975, x + a, m - x + b)) for x, m in zip(k, n)], columns=["lo", "hi"])

    out = df.withColumn("posterior_mean", beta_mean(F.col("successes"), F.col("n"), a, b)).withColumn("x", bounds(F.col("successes").cast("double"), F.col("n").cast("double")))
    return out.withColumn("cri_lo", F.col("x.lo")).withColumn("cri_hi", F.col("x.hi")).drop("x")


def report(df: DataFrame, by: list[str], digits: int = 3) -> DataFrame:
    """Rates with both formatted intervals and the lower of their lower bounds."""
    lo, hi = wilson(F.col("n"), F.col("rate"))
    shown = lambda a, b: F.format_string(f"[%.{digits}f, %.{digits}f]", a, b)
    r = beta_interval(df)
    return r.select(
        *by, "n", F.round("rate", digits).alias("rate"), shown(lo, hi).alias("interval"), F.round("posterior_mean", digits).alias("posterior_mean"),
        shown(F.col("cri_lo"), F.col("cri_hi")).alias("credible"), F.round(F.least(lo, F.col("cri_lo")), digits).alias("low"),
    )


def conservative_bound(df: DataFrame, by: list[str], panel: str) -> DataFrame:
    """The lower of the Wilson and the credible lower bound per row, and the least of a panel."""
    low = F.least(wilson(F.col("n"), F.col("rate"))[0], F.col("cri_lo"))
    return beta_interval(df).select(*by, low.alias("low")).withColumn("panel_low", F.min("low").over(Window.partitionBy(panel)))


def _numbered(df: DataFrame, column: str, by: list[str], key: str) -> DataFrame:
    """Values with their place in the group and the group's size."""
    w = Window.partitionBy(*by)
    rows = df.filter(F.col(column).isNotNull()).select(*by, key, F.col(column).cast("double").alias("x"))
    return rows.withColumn("i", (F.row_number().over(w.orderBy(key)) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))


def bootstrap(df: DataFrame, column: str, by: list[str], key: str = "qid", draws: int = 200, statistic: str = "mean") -> DataFrame:
    """Percentile bootstrap of the mean or median: ``lo, hi`` of 95 % per group.

    A replicate's draws are joined to values by place, so nothing is collected.
    """
    rows = _numbered(df, column, by, key)
    label = F.concat_ws("/", *by)
    asks = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(*by, "b", md5_index(F.col("n"), label, F.col("b"), F.col("i")).alias("i"))
    got = asks.join(rows.select(*by, "i", "x"), [*by, "i"])
    stat = F.avg("x") if statistic == "mean" else F.percentile("x", 0.5)
    return got.groupBy(*by, "b").agg(stat.alias("s")).groupBy(*by).agg(F.percentile("s", 0.025).alias("lo"), F.percentile("s", 0.975).alias("hi"))


def bayes_bootstrap(df: DataFrame, column: str, by: list[str], key: str = "qid", draws: int = 200, statistic: str = "mean") -> DataFrame:
    """Bayesian bootstrap: Dirichlet(1, ..) weights as normalised exponentials."""
    rows = _numbered(df, column, by, key)
    w = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", -F.log(md5_uniform(F.concat_ws("/", *by), F.col("b"), F.col("i"))))
    if statistic == "mean":
        s = w.groupBy(*by, "b").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("s"))
    else:
        each = Window.partitionBy(*by, "b")
        cum = F.sum("w").over(each.orderBy("x", "i").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(each)
        s = w.withColumn("cum", cum).groupBy(*by, "b").agg(F.min(F.when(F.col("cum") >= 0.5, F.col("x"))).alias("s"))
    return s.groupBy(*by).agg(F.percentile("s", 0.025).alias("lo"), F.percentile("s", 0.975).alias("hi"))


def _seed(label: str) -> np.random.Generator:
    """A generator that depends on a label alone, so reruns and partitionings agree."""
    return np.random.default_rng(list(hashlib.md5(label.encode()).digest()))


def dirichlet_mrr(df: DataFrame, by: list[str], draws: int = 50_000, k: int = 5) -> DataFrame:
    """Posterior of the mean reciprocal rank on the support 0, 1/k, .., 1/2, 1 with a flat prior.

    A group reaches its draws as ``k + 1`` counts, so their cost does not grow with its rows.
    """
    slot = F.when(F.col("mrr") > 0, F.rint(1.0 / F.col("mrr"))).otherwise(0)
    counts = [F.count_if(slot == r).cast("double").alias(f"c{r}") for r in range(k + 1)]
    g = df.filter("mrr is not null").groupBy(*by).agg(*counts)
    support = np.array([0.0] + [1.0 / r for r in range(1, k + 1)])

    @F.pandas_udf("struct<mean double, lo double, hi double>")
    def posterior(label: pd.Series, *cs: pd.Series) -> pd.DataFrame:
        rows = []
        for name, *c in zip(label, *cs):
            m = _seed("mrr|" + name).dirichlet(np.array(c) + 1.0, draws) @ support
            rows.append((m.mean(), *np.quantile(m, [0.025, 0.975])))
        return pd.DataFrame(rows, columns=["mean", "lo", "hi"])

    return g.withColumn("x", posterior(F.concat_ws("/", *by), *(F.col(f"c{r}") for r in range(k + 1)))).select(*by, "x.*")


#: Draws of one task of ``resampled``.
BLOCK_DRAWS = 500


def resampled(df: DataFrame, column: str, by: list[str], draws: int = 10_000, statistic: str = "mean", bayesian: bool = False) -> DataFrame:
    """Bootstrap (or Bayesian bootstrap) interval of a mean or median: ``n, mean, lo, hi`` of 95 % per group.

    Rows reach the draws as counts per distinct value: n draws with replacement
    are multinomial counts over the values, and a value's Dirichlet(1, ..)
    weights of its rows sum to a Gamma weight of its count.  So a draw costs as
    many numbers as there are values, and blocks of draws are tasks of their own.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    packed = values.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("x", "c"))).alias("xs"))
    blocks = -(-draws // BLOCK_DRAWS)
    dealt = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("label", F.concat_ws("|", F.concat_ws("/", *by), F.col("block").cast("string")))

    @F.pandas_udf("array<double>")
    def drawn(label: pd.Series, xs: pd.Series, block: pd.Series) -> pd.Series:
        out = []
        for name, items, b in zip(label, xs, block):
            x, c = np.array([i["x"] for i in items]), np.array([i["c"] for i in items], float)
            rng, size, stats = _seed(name), min(BLOCK_DRAWS, draws - b * BLOCK_DRAWS), []
            for lo in range(0, size, 50):
                some = min(50, size - lo)
                w = rng.standard_gamma(c, (some, len(c))) if bayesian else rng.multinomial(int(c.sum()), c / c.sum(), some).astype(float)
                if statistic == "mean":
                    stats += (w @ x / w.sum(1)).tolist()
                    continue
                cum = w.cumsum(1) / w.sum(1)[:, None]
                at = (cum >= 0.5 - 1e-12).argmax(1)
                if bayesian:
                    stats += x[at].tolist()
                else:  # an even number of rows has two middle ones
                    above = (cum > 0.5 + 1e-12).argmax(1)
                    stats += ((x[at] + x[above]) / 2).tolist()
            out.append(stats)
        return pd.Series(out)

    seen = dealt.repartition(*by, "block").select(*by, F.explode(drawn("label", "xs", "block")).alias("s"))
    ends = seen.groupBy(*by).agg(F.percentile("s", 0.025).alias("lo"), F.percentile("s", 0.975).alias("hi"))
    middle = values.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"))
    return middle.join(ends, by)


def cube_means(df: DataFrame, column: str, median: bool = False) -> DataFrame:
    """Means (and medians) by mode, by difficulty, by both and overall, in one pass."""
    more = [F.median(column).alias("median")] if median else []
    c = df.cube("difficulty", "mode").agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.grouping_id().cast("long").alias("level"), *more)
    return c.select("difficulty", "mode", "level", "n", "mean", *(["median"] if median else []))


def beta_mle(n: float, mean: float, var: float, mean_ln: float, mean_ln1: float) -> tuple[float, float]:
    """Beta parameters from sufficient statistics: moments, then nudges that raise the likelihood."""
    if n < 2:
        return math.nan, math.nan
    scale = mean * (1 - mean) / max(var, 1e-6) - 1
    a, b = max(mean * scale, 1e-3), max((1 - mean) * scale, 1e-3)
    like = lambda p, q: (p - 1) * mean_ln + (q - 1) * mean_ln1 - (math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q))
    best = like(a, b)
    for _ in range(50):
        tries = [(a * s, b) for s in (1.05, 0.95)] + [(a, b * s) for s in (1.05, 0.95)]
        value, p, q = max((like(p, q), p, q) for p, q in tries)
        if n * (value - best) <= 1e-6:
            break
        best, a, b = value, p, q
    return a, b


def zoib_mean(df: DataFrame, column: str, by: list[str], draws: int = 20_000) -> DataFrame:
    """Posterior of a group's mean under a zero-one-inflated beta: exact mean, and 95 % bounds by draws.

    The shares of zeros, ones and the middle are Dirichlet with a flat prior; the
    middle's mean comes from a fitted beta, 0.5 where there is none to fit.  Only
    a few sums per group leave the aggregation.
    """
    x = F.col(column)
    mid = (x > 1e-12) & (x < 1 - 1e-12)
    m = F.when(mid, x)
    stats = df.groupBy(*by).agg(F.count(x).alias("n"), F.count_if(x <= 1e-12).alias("zeros"), F.count_if(x >= 1 - 1e-12).alias("ones"), F.count(m).alias("middle"), F.avg(m).alias("m1"), F.var_pop(m).alias("m2"), F.avg(F.log(m)).alias("ln"), F.avg(F.log1p(-m)).alias("ln1"))

    @F.pandas_udf("struct<a double, b double, lo double, hi double>")
    def fit(label: pd.Series, zeros: pd.Series, ones: pd.Series, n: pd.Series, mean: pd.Series, var: pd.Series, ln: pd.Series, ln1: pd.Series) -> pd.DataFrame:
        rows = []
        for name, c0, c1, cm, *r in zip(label, zeros, ones, n, mean, var, ln, ln1):
            a, b = beta_mle(cm, *r)
            mu = a / (a + b) if a == a else 0.5
            w = _seed("zoib|" + name).dirichlet([c0 + 1.0, c1 + 1.0, cm + 1.0], draws)
            rows.append((a, b, *np.quantile(w[:, 1] + w[:, 2] * mu, [0.025, 0.975])))
        return pd.DataFrame(rows, columns=["a", "b", "lo", "hi"])

    f = stats.withColumn("f", fit(F.concat_ws("/", *by), *(F.col(c).cast("double") for c in ("zeros", "ones", "middle")), "m1", "m2", "ln", "ln1"))
    mu = F.coalesce(F.nanvl(F.col("f.a") / (F.col("f.a") + F.col("f.b")), F.lit(0.5)), F.lit(0.5))
    total = F.col("n") + 3
    mean = (F.col("ones") + 1) / total + (F.col("middle") + 1) / total * mu
    return f.select(*by, "n", "zeros", "ones", "middle", mean.alias("mean"), F.col("f.lo").alias("lo"), F.col("f.hi").alias("hi"), F.col("f.a").alias("alpha"), F.col("f.b").alias("beta"))


def ndcg_summary(df: DataFrame, column: str, by: list[str], draws: int = 10_000) -> DataFrame:
    """Twelve fields per group: size, mean with bootstrap bounds, posterior mean with bounds, shares of 0, 1 and between, fitted beta."""
    b = resampled(df, column, by, draws).select(*by, F.col("mean").alias("mean_ndcg"), F.col("lo").alias("boot_low"), F.col("hi").alias("boot_high"))
    z = zoib_mean(df.filter(F.col(column).isNotNull()), column, by)
    return z.join(b, by).select(
        *by, "n", "mean_ndcg", "boot_low", "boot_high", F.col("mean").alias("bayes_mean"), F.col("lo").alias("bayes_low"), F.col("hi").alias("bayes_high"),
        (F.col("zeros") / F.col("n")).alias("zero_rate"), (F.col("ones") / F.col("n")).alias("one_rate"), (F.col("middle") / F.col("n")).alias("mid_rate"),
        F.col("alpha").alias("beta_alpha_hat"), F.col("beta").alias("beta_beta_hat"),
    )


def ndcg_pair(df: DataFrame, column: str, by: list[str], draws: int = 20_000) -> DataFrame:
    """The bootstrap and the Bayesian bootstrap interval of a mean side by side."""
    f = resampled(df, column, by, draws).select(*by, "n", F.col("mean").alias("ndcg_mean"), F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    b = resampled(df, column, by, draws, bayesian=True).select(*by, F.col("lo").alias("cr_low"), F.col("hi").alias("cr_high"))
    return f.join(b, by)


def precision_posterior(df: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """Beta-binomial from per-query precision: hits of trials, flat prior, mean and equal-tailed bounds."""
    hits = F.greatest(F.lit(0.0), F.least(F.lit(float(k)), F.rint(F.col("precision_gold") * k)))
    g = df.filter("precision_gold is not null").groupBy(*by).agg(F.sum(hits).cast("long").alias("successes"), (F.count(F.lit(1)) * k).alias("n"))
    return beta_interval(g, 1.0, 1.0)


def gold_summary(df: DataFrame, column: str, by: list[str], draws: int = 10_000) -> DataFrame:
    """Size, mean with bootstrap bounds, median and quartiles per group."""
    q = df.filter(F.col(column).isNotNull()).groupBy(*by).agg(F.percentile(column, 0.5).alias("median"), F.percentile(column, 0.25).alias("q25"), F.percentile(column, 0.75).alias("q75"))
    return resampled(df, column, by, draws).join(q, by)


def trade_off(df: DataFrame) -> DataFrame:
    """Mean precision against mean recall per difficulty and mode."""
    p = df.groupBy("difficulty", "mode").agg(F.avg("precision_gold").alias("precision"))
    r = df.groupBy("difficulty", "mode").agg(F.avg("recall_gold").alias("recall"))
    return p.join(r, ["difficulty", "mode"])


def design_matrix(df: DataFrame, modes: list[str], base_difficulty: str, *kept: str) -> DataFrame:
    """Treatment-coded mode * difficulty: intercept, dummies and their products, and columns ``kept`` as they are."""
    d = (F.col("difficulty") != base_difficulty).cast("int")
    cols = {"intercept": F.lit(1), "x_difficulty": d}
    for k, m in enumerate(modes[1:], 1):
        cols[f"x_mode{k}"] = (F.col("mode") == m).cast("int")
        cols[f"x_inter{k}"] = (F.col("mode") == m).cast("int") * d
    return df.select("qid", "difficulty", "mode", *kept, *(c.alias(n) for n, c in cols.items()))


def condition_draws(conditions: DataFrame, draws: DataFrame) -> DataFrame:
    """Inverse-logit of the linear predictor per condition and draw (random effect 0).

    ``conditions`` is the design's grid, a row per difficulty and mode; it goes to the draws as an array.
    """
    eta = F.col("b0") + F.col("b_mode") * F.col("mode_ord") + F.col("b_diff") * F.col("is_difficult")
    grid = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in conditions.columns)) for r in conditions.collect()))
    return draws.select("*", F.inline(grid)).select("difficulty", "mode", "mode_ord", "sample_id", (1 / (1 + F.exp(-eta))).alias("value"))


def hdi(draws: DataFrame, by: list[str], n: int, mass: float = 0.95, column: str = "value") -> DataFrame:
    """Narrowest interval that holds ``mass`` of ``n`` draws per group."""
    w = Window.partitionBy(*by).orderBy(column, "sample_id")
    wide = draws.withColumn("hi", F.lead(column, int(mass * n)).over(w)).filter("hi is not null")
    best = F.min(F.struct((F.col("hi") - F.col(column)).alias("width"), F.col(column).alias("lo"), F.col("hi"))).alias("x")
    return wide.groupBy(*by).agg(best).select(*by, F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))


def expected_values(draws: DataFrame, inflation: DataFrame) -> DataFrame:
    """``value`` of each draw with inflation: ``p_one + p_middle * value``; ``inflation`` has a row per draw."""
    return draws.join(inflation.select("sample_id", "p_one", "p_middle"), "sample_id").withColumn("value", F.col("p_one") + F.col("p_middle") * F.col("value")).drop("p_one", "p_middle")


def summary_of_draws(draws: DataFrame, by: list[str], n: int, column: str = "value", mass: float = 0.95) -> DataFrame:
    """Mean, narrowest 95 % interval and the share above 0 of ``n`` draws per group."""
    # The narrowest interval and the rest from one pass over sorted draws, as ``hdi`` has it.
    w = Window.partitionBy(*by).orderBy(column, "sample_id")
    wide = draws.withColumn("hi", F.lead(column, int(mass * n)).over(w))
    best = F.min(F.when(F.col("hi").isNotNull(), F.struct((F.col("hi") - F.col(column)).alias("width"), F.col(column).alias("lo"), F.col("hi")))).alias("x")
    g = wide.groupBy(*by).agg(F.avg(column).alias("mean"), F.avg((F.col(column) > 0).cast("double")).alias("p_greater"), best)
    return g.filter("x is not null").select(*by, "mean", "p_greater", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))


def contrasts(draws: DataFrame, n: int, within: list[str] | None = None) -> DataFrame:
    """Pairwise differences of modes per draw: mean, narrowest interval, P(A > B) and its label.

    Averaged over difficulty, or within each of ``within``.
    """
    by = within or []
    m = draws.groupBy(*by, "mode", "mode_ord", "sample_id").agg(F.avg("value").alias("value"))
    a, b = m.alias("a"), m.alias("b")
    on = (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.mode_ord") < F.col("b.mode_ord"))
    for c in by:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    d = a.join(b, on).select(*(F.col(f"a.{c}").alias(c) for c in by), F.col("a.mode").alias("mode_a"), F.col("b.mode").alias("mode_b"), "a.sample_id", (F.col("a.value") - F.col("b.value")).alias("value"))
    out = summary_of_draws(d, [*by, "mode_a", "mode_b"], n).withColumnRenamed("mean", "delta")
    return out.withColumn("evidence", evidence(F.col("p_greater")))


def main_effects(draws: DataFrame, n: int, base_mode: str, first: str = "easy", second: str = "difficult") -> DataFrame:
    """The effect of difficulty averaged over modes, and of each mode against a base averaged over difficulty."""
    of = lambda d: F.first(F.when(F.col("difficulty") == d, F.col("value")), ignorenulls=True)
    # One exchange serves both aggregations.
    modes = draws.repartition("sample_id").groupBy("mode", "sample_id").agg(F.avg("value").alias("value"), (of(first) - of(second)).alias("gap"))
    is_base = F.col("mode") == base_mode
    per = modes.groupBy("sample_id").agg(
        F.avg("gap").alias("gap"), F.max(F.when(is_base, F.col("value"))).alias("base"), F.count_if(is_base).alias("bases"), F.collect_list(F.struct("mode", "value")).alias("modes")
    )
    easy = F.array(F.struct(F.lit(f"{first} - {second}").alias("effect"), F.col("gap").alias("value")))
    against = F.transform(F.filter("modes", lambda m: (m["mode"] != base_mode) & (F.col("bases") > 0)), lambda m: F.struct(F.concat(m["mode"], F.lit(f" - {base_mode}")).alias("effect"), (m["value"] - F.col("base")).alias("value")))
    effects = per.select("sample_id", F.inline(F.concat(easy, against)))
    return summary_of_draws(effects, ["effect"], n)


def interaction(draws: DataFrame, base_mode: str) -> DataFrame:
    """Difference in differences against a base mode: mean over draws."""
    wide = draws.groupBy("mode", "sample_id").pivot("difficulty", ["difficult", "easy"]).agg(F.first("value")).withColumn("gap", F.col("difficult") - F.col("easy"))
    base = wide.filter(F.col("mode") == base_mode).select("sample_id", F.col("gap").alias("base_gap"))
    return wide.filter(F.col("mode") != base_mode).join(base, "sample_id").groupBy("mode").agg(F.avg(F.col("gap") - F.col("base_gap")).alias("did"))


def evidence(p: Column) -> Column:
    """A label for a posterior probability."""
    return F.when(p >= 0.95, "strong A").when(p >= 0.80, "moderate A").when(p > 0.20, "inconclusive").when(p > 0.05, "moderate B").otherwise("strong B")


def mixed_model(df: DataFrame, label: str, features: list[str], group: str, family: str = "bernoulli", chains: int = 4, tune: int = 2000, draws: int = 2000, seed: int = 42, clip: float = 1e-4) -> DataFrame:
    """Posterior draws of a mixed model with a random intercept: ``chain, draw, parameter, value``.

    ``bernoulli``: success with a logistic mean.  ``beta``: labels inside (0, 1),
    clipped, with precision ~ Gamma(2, rate 0.1).  ``zoib``: labels inside are beta with
    precision ~ Exponential(2); zeros and ones have shares that are the softmax of
    three standard normal logits.  Effects are standard normal, the intercepts'
    deviation is half-normal.

    The intercepts are integrated out, group by group.  Groups stay on the
    executors, those that are alike once with their number.  Fewer groups with
    weights, whose sums have the same moments, stand for all of them where the log
    likelihood of all around its peak is the same; else only sums over all groups
    come back, for a round of draws at a time.  Features should have few distinct
    rows, as a design's have.
    """
    spark = df.sparkSession
    y = F.col(label).cast("double")
    told = df.filter(y.isNotNull())
    if family == "zoib":  # read twice
        told = told.select(group, *features, label).persist(StorageLevel.MEMORY_AND_DISK)
    inside = told.filter((y > 0) & (y < 1)) if family != "bernoulli" else told
    held = F.least(F.greatest(y, F.lit(clip)), F.lit(1 - clip)) if family == "beta" else y
    sums = (F.sum(y), F.lit(0.0)) if family == "bernoulli" else (F.sum(F.log(held)), F.sum(F.log1p(-held)))
    cells = inside.groupBy(group, *features).agg(F.count(F.lit(1)).cast("double").alias("n"), sums[0].alias("k"), sums[1].alias("k1"))
    p, phis = len(features), family != "bernoulli"
    stored = P.blocks(cells, group, features).persist(StorageLevel.MEMORY_AND_DISK)

    def wide(v: np.ndarray) -> np.ndarray:
        """What a deviation stretches effects by: divided by it, they hardly hang on the deviation."""
        return np.sqrt(1 + 0.346 * v[..., p, None] ** 2)

    def density(nodes: int, few: list | None) -> P.Evaluate:
        """Of effects over ``wide``, the deviation and the log precision, changes of variables counted; of ``few`` groups or all."""

        def at(v: np.ndarray) -> np.ndarray:
            by = wide(v)
            v = np.hstack([v[:, :p] * by, v[:, p:]])
            prior = p * np.log(by[:, 0]) - 0.5 * (v[:, : p + 1] ** 2).sum(1)
            if phis:
                prior += v[:, p + 1] - 2 * np.exp(v[:, p + 1]) if family == "zoib" else 2 * v[:, p + 1] - 0.1 * np.exp(v[:, p + 1])
            return prior + (P.summed(stored, v, family, nodes) if few is None else P.dealt(spark, few, v, family, nodes))

        return at

    def found(few: list | None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
        """The peak and the covariance there, nodes enough for it, points around it and their densities."""
        best, nodes = np.array([0.0] * p + [0.5] + [0.0] * phis), 8
        while True:
            best, cov = P.peak(density(nodes, few), best)
            reach = 4 * np.linalg.cholesky(cov).T
            around = np.concatenate([best[None], best + reach, best - reach])
            if np.abs((near := density(nodes, few)(around)) - density(2 * nodes, few)(around)).max() < P.CLOSE:
                return best, cov, nodes, around, near
            nodes *= 2
            if nodes > 8192:
                raise ValueError("a group's rows tell more of its intercept than 8192 nodes can follow")

    try:
        for terms in (*P.TERMS, 0):
            few = P.condensed(stored, terms) if terms else None
            if terms and few is None:
                continue
            try:
                best, cov, nodes, around, near = found(few)
            except (np.linalg.LinAlgError, ValueError):
                if few is None:
                    raise
                continue
            # Condensed groups serve where all groups, in full, have the same differences.
            if few is None or np.ptp(density(nodes, None)(around) - near) < P.SAME:
                break
        drawn = P.sampled(density(nodes, few), best, cov, chains, tune, draws, seed, folded=p)
        drawn[:, :, :p] *= wide(drawn)
        drawn[:, :, p] = np.log(drawn[:, :, p])
        known = [*features, "log_sd", *["log_phi"] * phis]
        if family == "zoib":
            counts = np.array([float(c) for c in told.agg(F.count_if(y <= 0), F.count_if(y >= 1), F.count_if((y > 0) & (y < 1))).first()])
            shares = lambda v: v @ counts - counts.sum() * np.logaddexp.reduce(v, axis=1) - 0.5 * (v * v).sum(1)
            drawn = np.concatenate([drawn, P.sampled(shares, *P.peak(shares, np.zeros(3)), chains, tune, draws, seed + 1)], axis=2)
            known += ["logit_zero", "logit_one", "logit_middle"]
    finally:
        stored.unpersist()
        if family == "zoib":
            told.unpersist()
    at = np.indices(drawn.shape).reshape(3, -1)
    return spark.createDataFrame(pa.table({"chain": at[0], "draw": at[1], "parameter": np.array(known)[at[2]], "value": drawn.ravel()}))


def inflation_of(draws: DataFrame) -> DataFrame:
    """``sample_id, p_zero, p_one, p_middle`` of a ``zoib`` model's draws."""
    z = draws.groupBy("chain", "draw").pivot("parameter", ["logit_zero", "logit_one", "logit_middle"]).agg(F.first("value"))
    e = [F.exp(F.col(c)) for c in ("logit_zero", "logit_one", "logit_middle")]
    total = e[0] + e[1] + e[2]
    return z.select(F.concat_ws("/", "chain", "draw").alias("sample_id"), *((v / total).alias(c) for v, c in zip(e, ("p_zero", "p_one", "p_middle"))))


def model_conditions(draws: DataFrame, modes: list[str], base_difficulty: str, other_difficulty: str) -> DataFrame:
    """Mean per condition and draw of a fitted model on ``design_matrix`` effects (random effect 0)."""
    effects = ["intercept", "x_difficulty", *(f"x_{kind}{k}" for kind in ("mode", "inter") for k in range(1, len(modes)))]
    wide = draws.groupBy("chain", "draw").pivot("parameter", effects).agg(F.first("value")).withColumn("sample_id", F.concat_ws("/", "chain", "draw"))

    def cell(d: int, m: int) -> Column:
        eta = F.col("intercept") + F.col("x_difficulty") * d
        if m:
            eta = eta + F.col(f"x_mode{m}") + F.col(f"x_inter{m}") * d
        return F.struct(F.lit((base_difficulty, other_difficulty)[d]).alias("difficulty"), F.lit(modes[m]).alias("mode"), F.lit(m + 1).cast("long").alias("mode_ord"), (1 / (1 + F.exp(-eta))).alias("value"))

    return wide.select("sample_id", F.inline(F.array(*(cell(d, m) for d in (0, 1) for m in range(len(modes))))))
