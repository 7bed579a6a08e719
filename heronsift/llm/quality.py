"""Quality by compression: two zstandard dictionaries, one of good and one of bad text.

A text is cut into blocks, and every block is compressed with either dictionary.
Blocks keep the dictionaries' help alike in short and long texts.  The bad size
less the good size, divided by the size of the text, is positive where the text
resembles good text; that normalised difference, over the whole text and over
its worst block, becomes a probability by a logistic fit on held-out folds.

Dictionaries come from a bounded sample of labelled rows (``SAMPLE_DOCS`` per
class, none of more than ``SAMPLE_CHARS`` characters); scoring covers all rows
and whole texts.

Defined cases: null and empty texts have difference zero; without labelled
rows of both classes the score is the share of good labels, or 0; of labels
that repeat for a row the largest counts, of rows that repeat for a labelled id
the least text trains; all rows are scored row by row (null ids count as held out); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import fit_logistic
from .common import batched_by_bytes, crc32_bucket, written
from .toxicity import label_shares, sampled_labels, training_rows

SAMPLE_DOCS, SAMPLE_CHARS = 3000, 60_000
FOLDS = 3
#: Bytes of a block, and of either dictionary.
BLOCK, DICTIONARY = 512, 262_144
LEVEL = 3
EVIDENCE = ["difference", "worst_difference", "good_rate", "log_bytes"]


def blocks_of(text: str | None) -> list[bytes]:
    """The whole text in blocks of nearly equal size."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = -(-len(raw) // BLOCK)
    return [raw[len(raw) * k // n : len(raw) * (k + 1) // n] for k in range(n)]


def train(texts: list[str]) -> bytes:
    """A dictionary of the texts' blocks; of too little text, the text itself."""
    samples = [b for t in texts for b in blocks_of(t)]
    size = sum(map(len, samples))
    if len(samples) >= 50 and size > 50_000:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, size // 10), samples).as_bytes()
        except zstandard.ZstdError:  # samples too much alike
            pass
    return b"".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes by a good and a bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.with_ = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False, write_checksum=False) for d in (good, bad)]

    def of(self, texts: list[str | None]) -> np.ndarray:
        """(texts, 4): difference a byte of the whole, of the worst block, rate of the good one, log of bytes."""
        out = np.zeros((len(texts), 4))
        good, bad = (z.compress for z in self.with_)
        for k, t in enumerate(texts):
            parts = blocks_of(t)
            if parts:
                n = np.array([len(p) for p in parts], float)
                g = np.array([len(good(p)) for p in parts], float)
                d = np.array([len(bad(p)) for p in parts], float) - g
                out[k] = d.sum() / n.sum(), (d / n).min(), g.sum() / n.sum(), np.log1p(n.sum())
        return out


def quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    mod: int = 5,
    held: int = 0,
    sample_docs: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score`` and what the score comes from."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    evidence, w = fitted(docs, labels, label, mod, held, sample_docs, id_col, text_col)
    held_out = F.coalesce(crc32_bucket(F.col("doc_id"), mod) == held, F.lit(True))
    told = narrow.select("doc_id", evidence(F.col("text")).alias("e"))
    return told.select("doc_id", held_out.alias("held_out"), logistic(w, F.col("e")).alias("score"), *(F.col("e")[c].alias(c) for c in EVIDENCE))


def logistic(w: np.ndarray, e: Column) -> Column:
    """The calibrated score of a struct of ``EVIDENCE``."""
    z = sum((e[c] * float(x) for c, x in zip(EVIDENCE, w[1:])), F.lit(float(w[0])))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def fitted(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, sample_docs: int, id_col: str, text_col: str):
    """A function of a text column that gives a struct of ``EVIDENCE``, and the weights.

    Only texts go to Python; the rows around them stay where they are.
    """
    batched_by_bytes(docs)
    zeros, ones = label_shares(labels, label, mod, held)
    chosen = written(sampled_labels(labels, label, mod, held, sample_docs), "label-sample")
    rows = training_rows(docs, chosen, SAMPLE_CHARS, id_col, text_col).toPandas().sort_values("doc_id")  # the bounded sample
    y, texts = rows["label"].to_numpy(float), rows["text"].tolist()
    del rows
    if y.sum() and y.sum() < len(y):
        rng = np.random.default_rng(len(y))
        fold = rng.permutation(len(y)) % FOLDS
        x = np.zeros((len(y), len(EVIDENCE)))
        pick = lambda k, keep: [t for t, lab, ok in zip(texts, y, keep) if lab == k and ok]
        for f in range(FOLDS):
            own = Sizes(train(pick(1, fold != f)), train(pick(0, fold != f)))
            x[fold == f] = own.of([t for t, g in zip(texts, fold) if g == f])
        w = fit_logistic(x, y, 1e-5)
        w[0] += np.log(max(ones, 1) / max(zeros, 1)) - np.log(y.sum() / (len(y) - y.sum()))
        every = np.ones(len(y), bool)
        dictionaries = train(pick(1, every)), train(pick(0, every))
    else:
        share = ones / (zeros + ones) if zeros + ones else 0.0
        w, dictionaries = np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9)), *[0.0] * len(EVIDENCE)]), (b"", b"")

    @F.arrow_udf("struct<" + ", ".join(f"{c}: double" for c in EVIDENCE) + ">")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Sizes(*dictionaries)
        for texts in batches:
            parts = [sizes.of(texts.slice(lo, 256).to_pylist()) for lo in range(0, len(texts), 256)]
            e = np.concatenate(parts) if parts else np.zeros((0, len(EVIDENCE)))
            yield pa.StructArray.from_arrays([pa.array(e[:, k]) for k in range(len(EVIDENCE))], EVIDENCE)

    return evidence, w


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, label: str = "quality", mod: int = 5, held: int = 0, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns; nothing is shuffled."""
    evidence, w = fitted(docs, labels, label, mod, held, sample_docs, id_col, text_col)
    plain = [f"c{k}" for k in range(len(docs.columns))]  # any names may occur in docs
    scored = docs.toDF(*plain).withColumn("e", evidence(F.col(plain[docs.columns.index(text_col)])))
    return scored.filter(logistic(w, F.col("e")) >= least).select(*plain).toDF(*docs.columns)
