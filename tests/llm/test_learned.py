"""Classifiers: held-out accuracy and awkward rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from heronsift.llm import quality, toxicity
from heronsift.llm.calibration import fit_logistic, probability

DOCS, LABELS = "doc_id long, text string, label int, score double, evidence string", "doc_id long, toxic int, quality int"


def corpus(n=400):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "the", "on", "er", "ing", "re"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        bad, junk = i % 4 == 0, i % 5 == 1
        if bad:
            for _ in range(1 + len(words) // 25):
                words[rng.randrange(len(words))] = rng.choice(["vlork", "vlorkish", "skrumpf"]) + rng.choice(["", "er", "an"])
        if junk:
            words = [w + rng.choice(["%%%", "$$$", "###"]) for w in words]
        rows.append((i, " ".join(words), 0, 0.0, "e"))
        labels.append((i, int(bad), int(not junk)))
    return rows, labels


def held(i, mod, r):
    return zlib.crc32(str(i).encode()) % mod == r


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    w = fit_logistic(x, y, 1e-9)
    assert w == pytest.approx([0.5, 2, -1], abs=0.25)
    assert probability(w, x)[y == 1].mean() > probability(w, x)[y == 0].mean()


def test_shared_backoff_spreads_to_rare_forms():
    words = ["vlorkan", "vlorker", "tree", "house", "then"]
    m = toxicity.fit_tables(words, np.array([5.0, 5, 3, 3, 3]), np.array([0.0, 0, 30, 30, 30]))
    r = dict(zip(["vlorkish", "tree", "qqq"], toxicity.word_ratios(m, ["vlorkish", "tree", "qqq"])))
    assert r["vlorkish"] > 2 and r["tree"] < 0 < r["vlorkish"] - r["qqq"]


def test_toxicity(spark):
    rows, labels = corpus()
    extra = [(None, "vlork vlorker", 0, 0.0, "e"), (1000, None, 0, 0.0, "e"), (1001, " \n", 0, 0.0, "e"), (1002, "the on " * 40_000, 0, 0.0, "e"), (0, rows[0][1], 0, 0.0, "e")]
    docs = spark.createDataFrame(rows + extra, DOCS)
    odd = [(None, 1, 1), (5, None, None), (7, 7, 7), (labels[8][0], labels[8][1], 0)]
    got = toxicity.toxicity(docs, spark.createDataFrame(labels + odd, LABELS)).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    truth = dict((i, t) for i, t, _ in labels)
    mine = [r for r in got if r.doc_id in truth]
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in mine)
    out = [r for r in mine if r.held_out]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in out]) > 0.9


def test_quality(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (1000, None, 0, 0.0, "e"), (1001, "", 0, 0.0, "e")], DOCS)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], LABELS)
    got = quality.quality(docs, lab).collect()
    truth = {i: q for i, _, q in labels}
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(held(r.doc_id, 5, 0) for r in out)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in out]) > 0.95
    kept = quality.keep_good(docs, lab)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert sum(truth[i] for i in ids if i in truth) > 0.97 * sum(truth.values())
    assert sum(1 - truth[i] for i in ids if i in truth) < 0.1 * sum(1 - q for q in truth.values())


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1)]])
def test_one_class_or_none(spark, labels):
    docs = spark.createDataFrame([(1, "a", 0, 0.0, "e"), (2, None, 0, 0.0, "e")], DOCS)
    lab = spark.createDataFrame(labels, LABELS)
    for f in (toxicity.toxicity, quality.quality):
        assert [0 <= r.score <= 1 for r in f(docs, lab).collect()] == [True, True]
        assert f(docs.limit(0), lab).count() == 0


def test_many_rows_of_a_labelled_id(spark):
    rows, labels = corpus(120)
    many = spark.createDataFrame(rows + [rows[4]] * 3000 + [(5, "on the", 0, 0.0, "e")] * 50 + [(6, "the ing " * 60_000, 0, 0.0, "e")], DOCS).repartition(6)
    lab = spark.createDataFrame(labels, LABELS)
    chosen = toxicity.sampled_labels(lab, "toxic", 3, 1, 3000)
    picked = toxicity.training_rows(many, chosen, toxicity.SAMPLE_CHARS)
    assert picked.count() == picked.select("doc_id").distinct().count() == chosen.join(many.select("doc_id"), "doc_id", "left_semi").count()
    for f in (toxicity.toxicity, quality.quality):
        first, again = (sorted((r.doc_id, r.score) for r in f(d, lab).collect()) for d in (many, many.repartition(3)))
        assert len(first) == many.count() and [x[0] for x in first] == [x[0] for x in again]
        assert np.allclose([x[1] for x in first], [x[1] for x in again])


def test_two_models_equal_a_plain_one():
    # The tables' log ratio of a word is the difference of two plain interpolated models.
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(40)})
    n = {w: (rng.randint(0, 4), rng.randint(0, 9)) for w in words}
    d, order = toxicity.DISCOUNT, toxicity.ORDER
    keep = [w for w in words if sum(n[w])]
    padded = {w: "\x02" * (order - 1) + w + "\x03" for w in keep}
    tops = {p[i - order + 1 : i + 1] for p in padded.values() for i in range(order - 1, len(p))}
    chars = len({p[i] for p in padded.values() for i in range(order - 1, len(p))}) + 1

    def total(gram, k=None):
        return sum((n[w][k] if k is not None else sum(n[w])) * sum(p[i + 1 - len(gram) : i + 1] == gram for i in range(order - 1, len(p))) for w, p in padded.items())

    def shared(gram):
        """Continuation counts over both classes; what starts a word counts its occurrences."""
        if not gram:
            return 1 / chars
        m = len(gram)
        amount = lambda g: total(g) if m > 1 and g[0] == "\x02" else len({t[-m - 1 :] for t in tops if t.endswith(g)})
        same = {t[-m:] for t in tops if t[-m:-1] == gram[:-1]}
        c = {g: amount(g) for g in same}
        return (max(c[gram] - d, 0) + d * len(same) * shared(gram[1:])) / sum(c.values())

    def model(gram, k):
        same = {t for t in tops if t[:-1] == gram[:-1]}
        c = {t: total(t, k) for t in same}
        if not sum(c.values()):
            return shared(gram[1:])
        return (max(c[gram] - d, 0) + d * sum(v > 0 for v in c.values()) * shared(gram[1:])) / sum(c.values())

    tables = toxicity.fit_tables(keep, np.array([n[w][0] for w in keep], float), np.array([n[w][1] for w in keep], float))
    got = toxicity.word_ratios(tables, keep)
    for w, value in zip(keep, got):
        p = padded[w]
        want = sum(np.log(model(p[i - order + 1 : i + 1], 0)) - np.log(model(p[i - order + 1 : i + 1], 1)) for i in range(order - 1, len(p)))
        assert value == pytest.approx(want, abs=1e-4)


def test_blocks_cover_the_text():
    for t in ("", "é" * 5000, "abc", None):
        assert b"".join(quality.blocks_of(t)) == (t or "").encode()
