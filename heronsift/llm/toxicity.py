"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary labelled text, run over
every word of a text, with the word's start as context.  Their top order keeps
counts by class; all lower orders are one shared chain of Kneser-Ney
continuation counts over both classes.  A rare form of an abusive word is thus
judged by the stem that it shares with others, and what neither class has seen
scores nothing.  As the lower orders are shared they cancel in a difference of
logs wherever a character is new, so the pair of models shrinks to two tables:
a log ratio per seen sequence and a default per seen context.

A text's evidence is the difference of the toxic and the ordinary
log-likelihood per word, over the whole text, over its most toxic passage and
over its most toxic words; with the text's length, a logistic fit on held-out folds of the labelled rows makes it a probability.

Models are fitted on a bounded sample of labelled rows (``SAMPLE_DOCS`` per
class, none of more than ``SAMPLE_CHARS`` characters); scoring covers all rows
and whole texts.

Defined cases: null, empty and white-space texts have no evidence and get the
score of evidence zero; without labelled rows of both classes the score is the
share of toxic labels, or 0; of labels that repeat for a row the largest
counts, of rows that repeat for a labelled id the least text trains; all rows
are scored row by row (null ids count as held out); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import fit_logistic
from .common import batched_by_bytes, crc32_bucket, sample_by_hash, written

SAMPLE_DOCS, SAMPLE_CHARS = 3000, 60_000
FOLDS = 3
ORDER, DISCOUNT = 5, 0.75
#: Words of the passage in which toxicity is sought besides the whole text.
PASSAGE = 40
EVIDENCE = ["text_evidence", "passage_evidence", "word_evidence", "log_words"]
MEMO_WORDS = 400_000
_START, _END = "\x02", "\x03"
#: A model that knows no text.
NOTHING = {x: np.zeros(0, np.uint64) for x in ("gram", "ratio", "ctx", "default")}
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with start and end marks, the place of each
    character to predict, and the word that it belongs to."""
    pad = _START * (order - 1)
    flat = np.frombuffer("".join([pad + w + _END for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(flat != ord(_START))
    # A start mark inside a word is only a character less to predict.
    lengths = np.fromiter((len(w) + order for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    return flat, at, owner[at]


def _keys(flat: np.ndarray, at: np.ndarray, length: int, skip: int = 0) -> np.ndarray:
    """A 64-bit key of the ``length`` characters that end ``skip`` before each place."""
    key = np.full(len(at), length + 1, np.uint64)
    for k in range(length - 1, -1, -1):
        key = (key ^ (flat[at - k - skip].astype(np.uint64) + np.uint64(1))) * _PRIME
        key ^= key >> np.uint64(29)
    return key


def _tally(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed weights and where each first occurs."""
    u, first, inv = np.unique(key, return_index=True, return_inverse=True)
    return u, np.bincount(inv, weight, len(u)), first


def fit_tables(words: list[str], toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER, d: float = DISCOUNT) -> dict[str, np.ndarray]:
    """The pair of models as tables, from each word's count in either class."""
    flat, at, owner = _grams(words, order)
    weights = (toxic.astype(np.float32)[owner], ordinary.astype(np.float32)[owner])
    # Shared chain: probabilities of every distinct top sequence's suffixes.
    top, first = np.unique(_keys(flat, at, order), return_index=True)
    places = at[first]
    chars = len(np.unique(flat[at])) + 1
    p = np.full(len(places), 1.0 / chars)
    for m in range(1, order):
        longer, one = np.unique(_keys(flat, at, m + 1), return_index=True)
        sites = at[one]
        gram, ctx = _keys(flat, sites, m), _keys(flat, sites, m - 1, 1)
        # What starts a word has one left neighbour only: count its occurrences.
        starts = flat[sites - (m - 1)] == ord(_START)
        if m > 1 and starts.any():
            every, total, _ = _tally(_keys(flat, at, m), weights[0] + weights[1])
            amount = np.where(starts, total[np.searchsorted(every, gram)], 1.0)
        else:
            amount = np.ones(len(sites))
        g, gn, gi = _tally(gram, amount)
        c, cn, _ = _tally(ctx[gi], gn)
        types = np.bincount(np.searchsorted(c, ctx[gi]), minlength=len(c))
        mine, around = np.searchsorted(g, _keys(flat, places, m)), np.searchsorted(c, _keys(flat, places, m - 1, 1))
        p = (np.maximum(gn[mine] - d, 0) + d * types[around] * p) / cn[around]
    # Top order by class.
    context = _keys(flat, places, order - 1, 1)
    ctx_key = np.unique(context)
    inside = np.searchsorted(ctx_key, context)
    every = np.searchsorted(top, _keys(flat, at, order))
    logs, gammas = [], []
    for w in weights:
        n = np.bincount(every, w, len(top))
        total = np.bincount(inside, n, len(ctx_key))
        types = np.bincount(inside, n > 0, len(ctx_key))
        gamma = np.where(total > 0, d * types / np.maximum(total, 1e-300), 1.0)
        seen = np.where(total[inside] > 0, np.maximum(n - d, 0) / np.maximum(total[inside], 1e-300), 0.0)
        logs.append(np.log(seen + gamma[inside] * p))
        gammas.append(np.log(gamma))
    return {"gram": top, "ratio": (logs[0] - logs[1]).astype(np.float32), "ctx": ctx_key, "default": (gammas[0] - gammas[1]).astype(np.float32)}


def word_ratios(model: dict[str, np.ndarray], words: list[str], order: int = ORDER) -> np.ndarray:
    """Toxic less ordinary log-likelihood of each word."""
    if not words or not len(model["gram"]):
        return np.zeros(len(words))
    flat, at, owner = _grams(words, order)

    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return k, keys[k] == wanted

    k, known = find(model["gram"], _keys(flat, at, order))
    value = np.where(known, model["ratio"][k], np.float32(0))
    rest = np.flatnonzero(~known)
    k, known = find(model["ctx"], _keys(flat, at[rest], order - 1, 1))
    value[rest] = np.where(known, model["default"][k], np.float32(0))
    return np.bincount(owner, value, len(words))


class Evidence:
    """Scores texts with one model; remembers the words of two generations."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model = model
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def of(self, texts: list[str | None]) -> np.ndarray:
        """(texts, 4): difference per word over the whole text, over its most toxic
        passage, over its three most toxic distinct words; and the log of its length."""
        parts = [(t or "").lower().split() for t in texts]
        unseen = {w for p in parts for w in p}.difference(self.young)
        if len(self.young) + len(unseen) > MEMO_WORDS:
            self.old, self.young = self.young, {}
            unseen = {w for p in parts for w in p}
        fresh = [w for w in unseen if w not in self.old]
        self.young.update((w, self.old[w]) for w in unseen if w in self.old)
        for lo in range(0, len(fresh), 20_000):
            some = fresh[lo : lo + 20_000]
            self.young.update(zip(some, word_ratios(self.model, some).tolist()))
        get = self.young.__getitem__
        out = np.zeros((len(parts), 4))
        for k, p in enumerate(parts):
            if p:
                ratios = np.fromiter(map(get, p), float, len(p))
                run = np.concatenate([[0.0], np.cumsum(ratios)])
                out[k, 0] = run[-1] / len(p)
                width = min(PASSAGE, len(p))
                out[k, 1] = (run[width:] - run[:-width]).max() / width
                out[k, 2] = np.unique(ratios)[-3:].mean()
                out[k, 3] = np.log1p(len(p))
        return out


def sampled_labels(labels: DataFrame, label: str, mod: int, held: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """``rows`` labelled ids of each class at most, never of the held-out remainder.

    Of labels that repeat the largest counts.  Bounded: twice ``rows``.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (crc32_bucket(F.col(id_col), mod) != held))
    one = usable.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    parts = [sample_by_hash(one.filter(F.col("label") == k), "doc_id", rows, label) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def label_shares(labels: DataFrame, label: str, mod: int, held: int, id_col: str = "doc_id") -> tuple[int, int]:
    """How many training labels are 0 and 1."""
    usable = labels.filter((crc32_bucket(F.col(id_col), mod) != held) & F.col(id_col).isNotNull())
    r = usable.agg(F.count(F.when(F.col(label) == 0, 1)), F.count(F.when(F.col(label) == 1, 1))).first()
    return int(r[0]), int(r[1])


def training_rows(docs: DataFrame, chosen: DataFrame, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, label, text`` of the chosen ids that are not over-long, written once.

    Of rows that share an id the least text counts, so there is a row per id at most.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.char_length("text") <= max_chars)
    one = picked.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # two samples of ids
    return written(one, "labelled")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    mod: int = 3,
    held: int = 1,
    sample_docs: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score`` and what the score comes from."""
    spark = batched_by_bytes(docs).sparkSession
    zeros, ones = label_shares(labels, label, mod, held)
    rows = training_rows(docs, written(sampled_labels(labels, label, mod, held, sample_docs), "label-sample"), SAMPLE_CHARS, id_col, text_col)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = rows.withColumn("fold", fold)
    # Word counts of the bounded sample, by class and fold.
    words = rows.select("label", "fold", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter("word <> ''")
    sums = [F.count(F.when((F.col("label") == k) & (F.col("fold") == f), 1)).alias(f"n{k}{f}") for k in (0, 1) for f in range(FOLDS)]
    counts = words.groupBy("word").agg(*sums).toArrow()  # compact: rows as Python objects would take ten times as much
    table, total = counts.column("word").to_pylist(), {(k, f): counts.column(f"n{k}{f}").to_numpy().astype(np.float32) for k in (0, 1) for f in range(FOLDS)}
    del counts

    def without(fold_out: int | None) -> dict[str, np.ndarray]:
        n = [sum((total[k, f] for f in range(FOLDS) if f != fold_out), np.zeros(len(table), np.float32)) for k in (0, 1)]
        held_in = np.flatnonzero(n[0] + n[1] > 0)
        if not len(held_in):
            return NOTHING
        return fit_tables([table[i] for i in held_in], n[1][held_in], n[0][held_in])

    def scorer(models):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = {f: Evidence(m) for f, m in models.value.items()}
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    s = b.slice(lo, 256)
                    texts, which = s.column(1).to_pylist(), np.array(s.column(2).to_pylist())
                    e = np.zeros((len(texts), 4))
                    for f in set(which.tolist()):
                        mine = np.flatnonzero(which == f)
                        e[mine] = by[f].of([texts[i] for i in mine])
                    yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array(e[:, k]) for k in range(4))], ["doc_id", *EVIDENCE])

        return run

    out = "doc_id long" + "".join(f", {c} double" for c in EVIDENCE)
    fit = rows.select("doc_id", "label").toPandas()
    n1 = int((fit["label"] == 1).sum())
    if n1 and n1 < len(fit):
        folds = spark.sparkContext.broadcast({f: without(f) for f in range(FOLDS)})
        held_in = rows.select("doc_id", "text", "fold").mapInArrow(scorer(folds), out).toPandas()
        labelled = held_in.merge(fit, on="doc_id")
        w = fit_logistic(labelled[EVIDENCE].to_numpy(), labelled["label"].to_numpy(float))
        w[0] += np.log(max(ones, 1) / max(zeros, 1)) - np.log(n1 / (len(fit) - n1))  # the sample's classes are not in their natural shares
        folds.unpersist()
        model = without(None)
    else:
        share = ones / (zeros + ones) if zeros + ones else 0.0
        w, model = np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9)), *[0.0] * len(EVIDENCE)]), NOTHING
    whole = spark.sparkContext.broadcast({0: model})
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).alias("which"))
    z = sum((F.col(c) * float(x) for c, x in zip(EVIDENCE, w[1:])), F.lit(float(w[0])))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    held_out = F.coalesce(crc32_bucket(F.col("doc_id"), mod) == held, F.lit(True))
    return narrow.mapInArrow(scorer(whole), out).select("doc_id", held_out.alias("held_out"), score.alias("score"), *EVIDENCE)
