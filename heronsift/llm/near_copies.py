"""Near copies by shingle similarity: SimHash's Gray-order index with a check of its pairs.

The SimHash operator where a similarity of word shingles is asked for, not a
number of bits.  Texts of a similarity of 0.8 differ in about 10 of 64 bits, so
no block of a fingerprint need agree; fingerprints are dealt by pairs of
min-wise shingle hashes instead (one pair of eight agrees with probability
0.9997 at 0.8).  Within a bucket the fingerprints, of ``MAX_BITS`` differing bits
at most, are found by the Gray-order hierarchy; groups that are joined with the
searching fingerprint already are dropped as a whole.  Each pair found is judged
by sketches of ``BINS`` min-wise hashes, whose estimate of the similarity has a
standard error of 0.025 at 0.8 and is nearly exact for texts of fewer shingles.

Texts of one shingle set are one node, so a huge group of copies is one row.  A
bucket yields a spanning forest of its links.  A bucket of more than
``SHARE_ROWS`` nodes is cut into shares, and any two shares meet in a task of
their own, so no task holds more than two and no pair is missed.

Defined cases: null, empty and white-space texts have no shingles and are one
node; fewer words than a shingle has: the whole sequence is one shingle; null
ids take part and are kept only where all ids of a group are null; of rows alike
in id and text one is kept; an empty table gives an empty result; columns of any
names are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched_by_bytes, keep_rows, written
from .components import connected_components
from .simhash import GrayForest, gray_rank, majority, spanning
from .substring_dedup import word_hashes

WORDS, SIMILARITY = 5, 0.8
#: Differing bits up to which a pair is judged: at similarity 0.8 about 10 differ, with a deviation of 3.
MAX_BITS = 20
#: Min-wise hashes of a sketch, and pairs of them by which fingerprints are dealt.
BINS, BANDS = 256, 8
#: Nodes of a share of a large bucket.
SHARE_ROWS = 50_000
#: Rows searched together, and pairs judged together.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 14

_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_EDGES = np.arange(1, BINS, dtype=np.uint64) << np.uint64(56)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each word shingle, repeats included."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + len(h)]) * _A
        h ^= h >> np.uint64(32)
    h = h * _B
    return h ^ (h >> np.uint64(31))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``BINS`` bytes, and the keys of ``BANDS`` bands, from a sorted set of hashes.

    A hash falls into the bin of its upper eight bits; a bin's byte comes from
    its least hash, zero if it has none.
    """
    first = np.concatenate([[0], np.searchsorted(hashes, _EDGES)])
    full = np.flatnonzero(np.append(first[1:], len(hashes)) > first)
    out = np.zeros(BINS, np.uint8)
    out[full] = (((hashes[first[full]] * _A) >> np.uint64(32)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    # Wider bins for the bands; an empty one borrows from the next that is not.
    wide = first[:: BINS // (2 * BANDS)] % max(1, len(hashes))
    least = hashes[wide] if len(hashes) else np.zeros(2 * BANDS, np.uint64)
    band = np.arange(BANDS, dtype=np.uint64)
    keys = ((least[0::2] * _A) ^ (least[1::2] >> np.uint64(7)) ^ least[1::2] * _B) * np.uint64(BANDS) + band
    return out, keys


def marks(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, locator, two digests of its shingle set, fingerprint, band keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            fp, d1, d2 = (np.zeros(n, np.uint64) for _ in range(3))
            keys, sketches = np.zeros((n, BANDS), np.uint64), []
            for k, t in enumerate(b.column(2)):
                h = shingle_hashes(t.as_py(), words)
                u = np.unique(h)
                made, keys[k] = sketch(u)
                fp[k] = majority(h)
                d1[k], d2[k] = np.bitwise_xor.reduce(u * _A) if len(u) else 0, (u * _B ^ (u >> np.uint64(29))).sum() if len(u) else 0
                sketches.append(made.tobytes())
            flat = pa.array(keys.ravel().view(np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x.view(np.int64)) for x in (d1, d2, fp)), listed, pa.array(sketches, pa.binary())], ["doc_id", "locator", "d1", "d2", "fp", "keys", "sketch"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("locator"), F.col(text_col).alias("text"))
    return batched_by_bytes(narrow).mapInArrow(run, "doc_id long, locator long, d1 long, d2 long, fp long, keys array<long>, sketch binary")


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row."""
    some = (a > 0) | (b > 0)
    return ((a == b) & some).sum(1) / np.maximum(some.sum(1), 1)


def similar_links(fp: np.ndarray, bucket: np.ndarray, sketches: np.ndarray, similarity: float, limit: int = MAX_BITS) -> np.ndarray:
    """The smallest place that links connect with each row; rows come sorted by bucket, then Gray rank."""
    n = len(fp)
    forest, label = GrayForest(fp, bucket), np.arange(n)
    lo, step = 0, 1
    while lo < n:
        hi = min(n, lo + step)
        for q, other in forest.open_pairs(np.arange(lo, hi), label, limit):
            for s in range(0, len(q), PAIRS_AT_ONCE):
                a, b = q[s : s + PAIRS_AT_ONCE], other[s : s + PAIRS_AT_ONCE]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                near = estimates(sketches[a], sketches[b]) >= similarity
                if near.any():
                    label = spanning(n, iter([(a[near], b[near])]), label)
        lo, step = hi, min(4 * step, 1024)
    return label


def _links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets at a time; rows come sorted by bucket."""
        held: list[pa.RecordBatch] = []
        rows = 0

        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            bucket, node, fp = (t.column(k).to_numpy() for k in range(3))
            fp = fp.view(np.uint64)
            order = np.lexsort((gray_rank(fp), bucket))
            sketches = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(-1, BINS)[order]
            node = node[order]
            label = similar_links(fp[order], bucket[order], sketches, similarity)
            tied = np.flatnonzero(label != np.arange(len(node)))
            return pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[label[tied]])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            if rows >= ROWS_AT_ONCE:
                own = b.column(0).to_numpy()
                other = np.flatnonzero(own != held[-1].column(0)[-1].as_py())
                if len(other):
                    cut = int(other[0])
                    yield out([*held, b.slice(0, cut)])
                    held, rows, b = [], 0, b.slice(cut)
            held.append(b)
            rows += b.num_rows
        if held:
            yield out(held)

    return run


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different shingle set: its digests, and the ``keeper`` of its component."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")
    seen = written(marks(docs, words, id_col, text_col), "near-marks")
    one = seen.groupBy("d1", "d2").agg(F.min(order).alias("keeper"), *(F.first(c).alias(c) for c in ("fp", "keys", "sketch")))
    nodes = written(one.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    # Keys that several nodes share, with the shares their buckets are cut into.
    shared = dealt.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SHARE_ROWS).cast("int").alias("shares"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
    met = dealt.join(shared, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    met = met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node")
    rows = met.join(nodes.select("node", "fp", "sketch"), "node").select("bucket", "node", "fp", "sketch")
    links = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(similarity), "a long, b long")
    roots = connected_components(links)
    named = nodes.select("node", "keeper", "d1", "d2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("keeper").alias("first"))
    return named.join(first, "root").select("d1", "d2", F.col("first").alias("keeper"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, that with the smallest id, with all its columns."""
    keep = near_copies(docs, words, similarity, id_col, text_col).select(F.col("keeper.doc_id").alias("hs_k_id"), F.col("keeper.locator").alias("hs_k_loc")).distinct()
    return keep_rows(docs, keep, id_col, text_col)
