"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most three of 64 bits agree in at least one of
four 16-bit blocks, so distinct fingerprints are dealt by block value; a block
value that very many share is dealt again by four parts of its other 48 bits.
Within each such bucket the fingerprints are sorted by their Gray rank and
grouped, eight by eight, into a hierarchy.  A node keeps the bits that all its
members share, less those its parent already holds, so a search adds up the
differences on its way down and drops a whole group once they exceed the limit.
Groups certain to lie within the limit are linked as a whole.  A bucket yields
a spanning forest of its links, which later joins into components; so output
is linear in the fingerprints and no link between different ones is lost.

Defined cases: null and empty texts and texts of white space have fingerprint
zero and are linked like any other; fewer words than a shingle has: the whole
sequence is one shingle; null ids take part and never name a component unless
all its ids are null; repeated rows get a row each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched_by_bytes, written
from .components import connected_components

#: Bits that may differ.  The dealing below is exact for up to three.
MAX_BITS = 3
FANOUT = 8
#: Buckets with more fingerprints are dealt again by their other bits.
LARGE_BUCKET = 20_000
#: Pairs of fingerprint and node that a search holds at once.
FRONTIER = 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LANES = np.uint64(0x0101010101010101)


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit hashes."""
    n = len(h)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    cuts = np.arange(0, n, 255)
    for k in range(8):  # byte lanes hold the counts of bits k, k+8, ..., of 255 hashes at most
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, cuts)
        counts[k::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > n)))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, locator``: the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), words, seed) for t in b.column(2)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(1)], ["doc_id", "fp", "locator"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("locator"), F.col(text_col).alias("text"))
    return batched_by_bytes(narrow).mapInArrow(run, "doc_id long, fp long, locator long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the Gray sequence."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayForest:
    """A hierarchy over each bucket of fingerprints that are sorted by bucket, then Gray rank.

    ``levels[0]`` are the fingerprints themselves.  Every node has ``first`` and
    ``count`` of its children one level down, the ``mask`` of the bits its members
    share, their ``pattern``, and the place ``last`` of its last fingerprint.
    """

    def __init__(self, fp: np.ndarray, bucket: np.ndarray):
        self.fp = fp
        n = len(fp)
        low, high = fp, fp
        owner = bucket
        self.levels = [{"first": np.arange(n), "count": np.ones(n, np.int64), "mask": np.full(n, ~np.uint64(0)), "pattern": fp, "last": np.arange(n), "head": np.arange(n)}]
        while True:
            new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(new, len(owner)))
            if sizes.max() == 1 and len(self.levels) > 1:
                break
            inside = np.arange(len(owner)) - np.repeat(new, sizes)
            first = np.flatnonzero(inside % FANOUT == 0)
            count = np.diff(np.append(first, len(owner)))
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            below = self.levels[-1]
            mask = ~(low ^ high)
            self.levels.append({"first": first, "count": count, "mask": mask, "pattern": low & mask, "last": below["last"][first + count - 1], "head": below["head"][first]})
            owner = owner[first]
        self.root_of = np.repeat(np.arange(len(owner)), np.diff(np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), n)))

    def links(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges (as places) that connect what all pairs within ``limit`` bits connect."""
        for level in self.levels[1:]:  # members of a node with few free bits are all within the limit
            tight = np.flatnonzero((np.bitwise_count(~level["mask"]) <= limit) & (level["last"] > level["head"]))
            if len(tight):
                size = level["last"][tight] - level["head"][tight]
                head = np.repeat(level["head"][tight], size)
                yield head, head + 1 + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        step = max(1, FRONTIER // (4 * FANOUT))
        for lo in range(0, len(self.fp), step):
            q = np.arange(lo, min(lo + step, len(self.fp)))
            yield from self._down(len(self.levels) - 1, q, self.root_of[q], np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64), limit)

    def open_pairs(self, q: np.ndarray, label: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the places ``q`` and later ones within ``limit`` bits, without those of one ``label``.

        A node whose members all bear the searcher's label is dropped as a whole.
        """
        least, most = label, label
        uniform = [label]
        for level in self.levels[1:]:
            least, most = np.minimum.reduceat(least, level["first"]), np.maximum.reduceat(most, level["first"])
            uniform.append(np.where(least == most, least, -1))
        todo = [(len(self.levels) - 1, q, self.root_of[q], np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64))]
        while todo:
            depth, q, node, spent, held = todo.pop()
            if len(q) > FRONTIER // FANOUT:  # as many as the frontier may hold once their children are out
                half = len(q) // 2
                todo += [(depth, q[half:], node[half:], spent[half:], held[half:]), (depth, q[:half], node[:half], spent[:half], held[:half])]
                continue
            level = self.levels[depth]
            mask = level["mask"][node]
            spent = spent + np.bitwise_count((self.fp[q] ^ level["pattern"][node]) & mask & ~held)
            near = (spent <= limit) & (level["last"][node] > q) & (uniform[depth][node] != label[q])
            q, node, spent, mask = q[near], node[near], spent[near], mask[near]
            if not len(q):
                continue
            if not depth:
                yield q, node
                continue
            c = level["count"][node]
            child = np.repeat(level["first"][node] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            todo.append((depth - 1, np.repeat(q, c), child, np.repeat(spent, c), np.repeat(mask, c)))

    def _down(self, depth: int, q: np.ndarray, node: np.ndarray, spent: np.ndarray, held: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``spent``: differences so far, in the bits ``held`` by the nodes above."""
        level = self.levels[depth]
        mask = level["mask"][node]
        spent = spent + np.bitwise_count((self.fp[q] ^ level["pattern"][node]) & mask & ~held)
        near = (spent <= limit) & (level["last"][node] > q)
        if depth:
            sure = near & (spent + np.bitwise_count(~mask) <= limit)
            if sure.any():
                yield q[sure], level["head"][node[sure]]
            near &= ~sure
        q, node, spent, mask = q[near], node[near], spent[near], mask[near]
        if not depth:
            yield q, node
            return
        if not len(q):
            return
        count = level["count"][node]
        ends = np.cumsum(count)
        lo = 0
        while lo < len(q):  # children of as many nodes as the frontier may hold
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FRONTIER, "right")))
            c = count[lo:hi]
            child = np.repeat(level["first"][node[lo:hi]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            yield from self._down(depth - 1, np.repeat(q[lo:hi], c), child, np.repeat(spent[lo:hi], c), np.repeat(mask[lo:hi], c), limit)
            lo = hi


def spanning(n: int, edges: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray | None = None) -> np.ndarray:
    """The smallest place connected with each of ``n`` places; ``label``: what is known of that."""
    label = np.arange(n) if label is None else label
    for a, b in edges:
        while len(a):
            a, b = label[a], label[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def bucket_links(fp: np.ndarray, bucket: np.ndarray, turn: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within buckets; ``turn``: bits to rotate by.

    The rotation puts the bucket's shared block first, so that Gray order acts on the rest.
    """
    spun = np.where(turn > 0, (fp << turn) | (fp >> ((np.uint64(64) - turn) & np.uint64(63))), fp)
    order = np.lexsort((gray_rank(spun), bucket))
    spun, bucket, kept = spun[order], bucket[order], fp[order]
    label = spanning(len(kept), GrayForest(spun, bucket).links(limit))
    tied = np.flatnonzero(label != np.arange(len(kept)))
    return kept[tied], kept[label[tied]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets at a time; rows come sorted by bucket."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def out(parts) -> pa.RecordBatch:
        bucket, fp, turn = (np.concatenate(x) for x in zip(*parts))
        a, b = bucket_links(fp.view(np.uint64), bucket, turn.astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if rows >= FRONTIER:
            other = np.flatnonzero(now[0] != held[-1][0][-1])
            if len(other):
                cut = int(other[0])
                held.append(tuple(x[:cut] for x in now))
                yield out(held)
                held, rows, now = [], 0, tuple(x[cut:] for x in now)
        held.append(now)
        rows += len(now[0])
    if held:
        yield out(held)


def near_links(distinct: DataFrame) -> DataFrame:
    """Edges ``a, b`` over a table of distinct ``fp`` that connect all within three bits."""
    u = lambda c, by, bits: F.shiftrightunsigned(c, by).bitwiseAND(F.lit((1 << bits) - 1))
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), u(F.col("fp"), 48 - 16 * k, 16).alias("value")) for k in range(4)))
    dealt = distinct.select("fp", F.explode(blocks).alias("x")).select("fp", (F.col("x.value") * 4 + F.col("x.block")).alias("key"), F.col("x.block").alias("block"))
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE_BUCKET).select("key", F.lit(True).alias("large"))
    # The other 48 bits of a fingerprint, and four parts of twelve bits of them.
    turned = F.expr(" ".join(["CASE block", *(f"WHEN {k} THEN {'fp' if not k else f'(shiftleft(fp, {16 * k}) | shiftrightunsigned(fp, {64 - 16 * k}))'}" for k in range(4)), "END"]))
    parts = F.array(*((u(turned, 36 - 12 * k, 12) * 4 + k + 1) for k in range(4)))
    told = dealt.join(sizes, "key", "left").withColumn("part", F.explode(F.when(F.col("large"), parts).otherwise(F.array(F.lit(0).cast("long")))))
    bucket = (F.col("key") * (1 << 15) + F.col("part")).alias("bucket")
    rows = told.select(bucket, "fp", (F.col("block") * 16).cast("int").alias("turn")).repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, locator, component_id``, and its component's first ``keeper``."""
    marks = written(fingerprints(docs, words, seed, id_col, text_col), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")
    by_fp = written(marks.groupBy("fp").agg(F.min(order).alias("keeper")), "simhash-distinct")
    roots = connected_components(near_links(by_fp.select("fp")))
    named = by_fp.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min("keeper").alias("keeper"))
    whole = named.select("fp", "root").join(first, "root").select("fp", "keeper")
    return marks.join(whole, "fp").select("doc_id", "fp", "locator", F.col("keeper.doc_id").alias("component_id"), "keeper")


def hex_fingerprint(fp: str = "fp") -> Column:
    """Sixteen lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

