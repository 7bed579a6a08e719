"""Mixed models: exact posteriors, many groups, nothing per group on the driver."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronsift.operators import posterior as P
from heronsift.operators import uncertainty as A


@pytest.fixture
def no_rows_on_driver(spark, monkeypatch):
    def refused(self):
        raise AssertionError("rows per group on the driver")

    monkeypatch.setattr(type(spark.range(0)), "toPandas", refused)


def drawn(df):
    """Draws by parameter, a row per chain."""
    rows = sorted((r.parameter, r.chain, r.draw, r.value) for r in df.collect())
    names = sorted({r[0] for r in rows})
    return dict(zip(names, np.array([r[3] for r in rows]).reshape(len(names), len({r[1] for r in rows}), -1)))


def agree(chains):
    """The chains' means are as near as their spread lets them be."""
    n = chains.shape[1]
    within, between = chains.var(axis=1, ddof=1).mean(), n * chains.mean(axis=1).var(ddof=1)
    return math.sqrt((n - 1) / n + between / n / within) < 1.01


def test_logistic_model_of_many_groups_has_the_exact_posterior(spark, no_rows_on_driver):
    q = spark.range(200_000).withColumnRenamed("id", "q")
    df = q.select("q", F.lit(1.0).alias("one"), F.explode(F.array(*((F.col("q") % 3 > k).cast("int") for k in (0, 1)))).alias("y"))
    got = drawn(A.mixed_model(df, "y", ["one"], "q"))
    assert got["one"].shape == (4, 2000) and all(agree(x) for x in got.values())
    # Groups have 0, 1 or 2 successes of 2: their probabilities over a grid of both parameters.
    b, s = (x.ravel() for x in np.meshgrid(np.linspace(-0.04, 0.04, 61), np.linspace(1.4, 2.2, 401)))
    u = np.linspace(-9, 9, 400)
    one = 1 / (1 + np.exp(-(b[:, None] + s[:, None] * u)))
    mass = np.exp(-u * u / 2) / np.exp(-u * u / 2).sum()
    sizes = [66_667, 66_667, 66_666]
    log = sum(n * np.log((one**k * (1 - one) ** (2 - k)) @ mass) for n, k in zip(sizes, (0, 1, 2))) - (b * b + s * s) / 2
    w = np.exp(log - log.max())
    w /= w.sum()
    assert max(w[(s == 1.4) | (s == 2.2)].max(), w[np.abs(b) == 0.04].max()) < 1e-6  # the grid holds it all
    for values, x in ((got["one"], b), (np.exp(got["log_sd"]), s)):
        mean, sd = w @ x, math.sqrt(w @ x**2 - (w @ x) ** 2)
        assert abs(values.mean() - mean) < 0.12 * sd and values.std() == pytest.approx(sd, rel=0.1)


def test_deviation_near_zero_is_drawn_whole(spark):
    """Without an effect of groups the deviation's posterior leans on 0, where its logarithm has a long tail."""
    rng = np.random.default_rng(8)
    k = rng.binomial(6, 0.5, 400)
    df = spark.createDataFrame([(q, 1.0, float(i < k[q])) for q in range(400) for i in range(6)], "q long, one double, y double")
    got = drawn(A.mixed_model(df, "y", ["one"], "q"))
    b, s = (x.ravel() for x in np.meshgrid(np.linspace(-0.25, 0.25, 41), np.linspace(1e-4, 0.8, 160)))
    u = np.linspace(-9, 9, 200)
    one = 1 / (1 + np.exp(-(b[:, None] + s[:, None] * u)))
    mass = np.exp(-u * u / 2) / np.exp(-u * u / 2).sum()
    log = sum(n * np.log((one**i * (1 - one) ** (6 - i)) @ mass) for i, n in enumerate(np.bincount(k, minlength=7))) - (b * b + s * s) / 2
    w = np.exp(log - log.max())
    w /= w.sum()
    values = np.exp(got["log_sd"])
    sd = math.sqrt(w @ s**2 - (w @ s) ** 2)
    assert abs(values.mean() - w @ s) < 0.12 * sd and (values < 0.03).mean() == pytest.approx(w[s < 0.03].sum(), abs=0.03)
    assert all(agree(x) for x in got.values())


@pytest.mark.parametrize("family", ["bernoulli", "beta"])
def test_likelihood_equals_a_plain_one(spark, family):
    rng = np.random.default_rng(3)
    rows = [(int(g), 1.0, float(x), float(rng.integers(2)) if family == "bernoulli" else float(rng.beta(2, 1))) for g in range(40) for x in rng.integers(0, 3, rng.integers(1, 6))]
    rows += [(None, 1.0, 1.0, 0.0 if family == "bernoulli" else 0.4)]
    y = F.col("y")
    k = (F.sum(y), F.lit(0.0)) if family == "bernoulli" else (F.sum(F.log(y)), F.sum(F.log1p(-y)))
    df = spark.createDataFrame(rows, "g long, one double, x double, y double")
    stored = P.blocks(df.groupBy("g", "one", "x").agg(F.count("y").cast("double").alias("n"), k[0].alias("k"), k[1].alias("k1")), "g", ["one", "x"])
    at = np.array([[0.3, -0.2, 0.7, 1.1], [-1.0, 0.5, 0.0, 0.2], [0.1, 0.1, -0.7, 2.0]])[:, : 3 if family == "bernoulli" else 4]
    u = np.linspace(-9, 9, 1001)
    mass = np.exp(-u * u / 2) / np.exp(-u * u / 2).sum()

    def density(eta, y, phi):
        if family == "bernoulli":
            return 1 / (1 + np.exp(-eta if y else eta))
        mu = 1 / (1 + np.exp(-eta))
        return np.array([math.exp(math.lgamma(phi) - math.lgamma(m * phi) - math.lgamma(phi - m * phi) + (m * phi - 1) * math.log(y) + (phi - m * phi - 1) * math.log(1 - y)) for m in mu])

    for found, (b0, b1, s, *phi) in zip(P.summed(stored, at, family, 64), at):
        plain = 0.0
        for g in {r[0] for r in rows}:
            plain += math.log(np.prod([density(b0 + b1 * x + s * u, y, math.exp(phi[0]) if phi else 0) for i, _, x, y in rows if i == g], axis=0) @ mass)
        assert found == pytest.approx(plain, abs=1e-6)


def planted(spark, groups: int, shares: list[float]):
    """Two labels a group, beta with an effect of x and an intercept of the group's, some of them 0 or 1."""
    rng = np.random.default_rng(11)
    q, x = np.repeat(np.arange(groups), 2), np.tile([0.0, 1.0], groups)
    mu = 1 / (1 + np.exp(-(-0.4 + 1.1 * x + 0.5 * rng.normal(size=groups)[q])))
    kind = rng.choice(3, size=len(q), p=shares)
    y = np.where(kind == 2, np.clip(rng.beta(8 * mu, 8 * (1 - mu)), 1e-4, 1 - 1e-4), kind)
    rows = [(a, 1.0, b, c) for a, b, c in zip(q.tolist(), x.tolist(), y.tolist())]
    return spark.createDataFrame(rows, "q long, one double, x double, y double"), [float((kind == i).mean()) for i in range(3)]


def test_beta_model_of_many_groups(spark, no_rows_on_driver):
    got = drawn(A.mixed_model(planted(spark, 5000, [0.0, 0.0, 1.0])[0], "y", ["one", "x"], "q", "beta"))
    assert got["x"].shape == (4, 2000) and all(agree(v) for v in got.values())
    means = [got["one"].mean(), got["x"].mean(), np.exp(got["log_sd"]).mean(), np.exp(got["log_phi"]).mean()]
    assert means == [pytest.approx(-0.4, abs=0.06), pytest.approx(1.1, abs=0.06), pytest.approx(0.5, abs=0.05), pytest.approx(8, rel=0.08)]


def evaluated_in_full(monkeypatch):
    """Points at which all groups are evaluated, counted."""
    points, summed = [], P.summed
    monkeypatch.setattr(P, "summed", lambda stored, at, *rest: points.append(len(at)) or summed(stored, at, *rest))
    return points


def test_condensed_groups_of_the_zoib_model_serve_for_all_draws(spark, monkeypatch, no_rows_on_driver):
    df, points = planted(spark, 2000, [0.2, 0.1, 0.7])[0], evaluated_in_full(monkeypatch)
    got = drawn(A.mixed_model(df, "y", ["one", "x"], "q", "zoib"))
    assert got["x"].shape == (4, 2000) and 0 < sum(points) < 100  # over 16,000 where every group is evaluated for every draw


def test_main_effects_shuffle_the_draws_once_for_their_means(spark):
    """A row per sample in one exchange, draws of an effect in another; the joins and repeated pivots took 10 and more."""
    rows = [(d, m, i, float(i % 7) * k + (d == "easy")) for i in range(400) for d in ("easy", "difficult") for k, m in enumerate("abc", 1)]
    out = A.main_effects(spark.createDataFrame(rows, "difficulty string, mode string, sample_id long, value double"), 400, "a")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3
    got = {r.effect: (r.mean, r.lo, r.hi, r.p_greater) for r in out.collect()}
    mean = sum(i % 7 for i in range(400)) / 400
    assert set(got) == {"easy - difficult", "b - a", "c - a"} and got["easy - difficult"] == (1.0, 1.0, 1.0, 1.0)
    for e, k in (("b - a", 1), ("c - a", 2)):
        assert got[e] == (pytest.approx(k * mean), 0.0, 6.0 * k, pytest.approx(sum(i % 7 > 0 for i in range(400)) / 400))


def test_condensed_groups_of_the_beta_model_have_the_same_posterior(spark, monkeypatch, no_rows_on_driver):
    df, points = planted(spark, 3000, [0.0, 0.1, 0.9])[0], evaluated_in_full(monkeypatch)
    got = drawn(A.mixed_model(df, "y", ["one", "x"], "q", "beta"))
    assert 0 < sum(points) < 100  # 16,000 in the samples alone, where every group is evaluated for every one
    monkeypatch.setattr(P, "TERMS", (6,))
    monkeypatch.setattr(P, "DEGREES", (2, 2))  # means and variances say too little, so all groups are used
    whole = drawn(A.mixed_model(df, "y", ["one", "x"], "q", "beta"))
    assert sum(points) > 16_000
    for name, values in whole.items():
        assert abs(got[name].mean() - values.mean()) < 0.02 * values.std() and got[name].std() == pytest.approx(values.std(), rel=0.02)


def test_condensed_blocks_keep_moments():
    rng = np.random.default_rng(4)
    block = [(np.array([[1.0, 0.0], [1.0, 1.0]]), np.hstack([np.ones((3000, 2)), rng.normal(size=(3000, 2)) ** 3]), rng.integers(1, 4, 3000).astype(float), 5.0, 7.0)]
    (x, sums, weight, *rest), = P.condensed_block(P.joined([block, block]), 28)
    assert len(weight) == 28 and (x == block[0][0]).all() and rest == [10.0, 14.0]
    for i in range(7):
        for j in range(7 - i):
            moment = lambda s, w: w @ (s[:, 2] ** i * s[:, 3] ** j)
            assert moment(sums, weight) == pytest.approx(2 * moment(block[0][1], block[0][2]), rel=1e-6, abs=1e-6 * 6000 * 60 ** ((i + j) / 2))
    many = [(np.eye(12), np.hstack([np.ones((3000, 12)), rng.normal(size=(3000, 12))]), np.ones(3000), 0.0, 0.0)]
    assert len(P.condensed_block(many, 500)[0][2]) == 3000  # too many moments: left as they are


def test_zoib_model_of_many_groups(spark, no_rows_on_driver):
    df, shares = planted(spark, 5000, [0.2, 0.1, 0.7])
    d = A.mixed_model(df, "y", ["one", "x"], "q", "zoib")
    got = drawn(d)
    assert got["x"].shape == (4, 2000) and all(agree(v) for v in got.values())
    means = [got["one"].mean(), got["x"].mean(), np.exp(got["log_sd"]).mean(), np.exp(got["log_phi"]).mean()]
    assert means == [pytest.approx(-0.4, abs=0.08), pytest.approx(1.1, abs=0.08), pytest.approx(0.5, abs=0.06), pytest.approx(8, rel=0.12)]
    p = A.inflation_of(d).agg(F.avg("p_zero"), F.avg("p_one"), F.avg("p_middle")).first()
    assert list(p) == [pytest.approx(s, abs=0.002) for s in shares]


def test_fitted_effects_of_many_queries(spark, monkeypatch, no_rows_on_driver):
    from heronsift.plans import registry

    q = spark.range(40_000).withColumnRenamed("id", "qid").withColumn("difficulty", F.when(F.col("qid") % 2 == 0, "easy").otherwise("difficult"))
    rows = q.select("*", F.posexplode(F.array(*map(F.lit, registry.MODES))).alias("i", "mode"))
    # Of ten queries of a difficulty, 4 + i succeed in mode i, and one more where they are easy; shifts keep queries apart.
    rows = rows.withColumn("success", (F.pmod(F.xxhash64("qid", "i"), F.lit(10)) < 4 + F.col("i") + (F.col("difficulty") == "easy").cast("int")).cast("double"))
    monkeypatch.setattr(registry, "metric_rows", lambda *_: rows)
    got = {r.effect: r for r in registry.QUERIES["a29_fitted_effects"](spark, "").collect()}
    assert set(got) == {"easy - difficult", *(f"{m} - BM25" for m in registry.MODES[1:])}
    wanted = {"easy - difficult": 0.1} | {f"{m} - BM25": i / 10 for i, m in enumerate(registry.MODES[1:], 1)}
    for effect, r in got.items():
        assert r.mean == pytest.approx(wanted[effect], abs=0.015) and r.lo < r.mean < r.hi < r.lo + 0.03 and r.p_greater == 1
