"""Approximate nearest neighbours over balanced posting lists.

Nearness is the largest inner product.  One extra coordinate, the root of the
largest squared norm less a vector's own, makes it a Euclidean search, in which
queries have zero there.

Centroids are fitted on a bounded sample by k-means whose lists are balanced:
a list of more than twice its share of the sample is split until none is.
Every row is then filed under its nearest centroid and, near a boundary, under
others almost as near (closer than ``REPLICA`` times the nearest distance, and
not standing behind a centroid already chosen).  A query walks a neighbourhood
graph over the centroids, kept in memory, and probes the lists whose distance
is within a ratio of the best one's, and as many more as hold candidates
enough; a query still left with too few asks all lists.  How many lists and
which ratio is read off a bounded sample of queries, whose true neighbours among
all rows are found by brute force.  Lists are searched by blocks of vectors and
blocks of queries, so a list that holds a third of all rows is many tasks' work.

Equal vectors are one: they have equal scores, and of their ids only the ``k + 1``
smallest can be among any query's ``k`` nearest.  So a vector that very many rows
or queries share is filed and asked once, and no result is lost.

Scores are inner products of the original vectors in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another length than the first one
by id; rows of null id are no queries and no candidates; rows alike in id and
score count once; a query leaves out all rows of its own id; ties go to
the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sample_by_hash, written

#: Vectors from which centroids are fitted (and their bytes), and the most centroids.
SAMPLE_ROWS, SAMPLE_BYTES, MAX_LISTS = 60_000, 32 << 20, 4096
#: Rows a list should hold until MAX_LISTS is reached.
LIST_ROWS = 200
#: Lists a row may be filed under, and how much farther than the nearest.
COPIES, REPLICA = 4, 1.10
#: Lists a query probes at most, and the distance ratio that prunes them: the
#: least of each; both grow until sample queries find their neighbours.
PROBES, RATIO = 48, 1.35
#: Queries of that sample, and the share of their neighbours to be found.
TRIALS, RECALL = 256, 0.97
#: Candidates that a query's lists hold at least, as a multiple of ``k``.
ENOUGH = 4
#: Neighbours of a centroid in the graph, and candidates a walk holds.
DEGREE, BEAM = 24, 96
#: Vectors of one block of a list, and queries of one block of those that probe it.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """About ``lists`` centroids, none with over twice its share of ``x`` where ``x`` can be split."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[: max(1, min(lists, len(distinct)))]]
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = total[n > 0] / n[n > 0, None]
    share, done = 2 * max(1, math.ceil(len(x) / max(1, lists))), []
    todo = [x[k] for k in _groups(_nearest(x, c))]
    while todo:
        part = todo.pop()
        if len(part) > share and (np.ptp(part, axis=0) > 0).any():
            axis = np.argmax(part.var(axis=0))
            cut = np.median(part[:, axis])
            low = part[:, axis] <= cut if (part[:, axis] > cut).any() else part[:, axis] < cut
            todo += [part[low], part[~low]]
        else:
            done.append(part.mean(axis=0))
    return np.array(done)


def _groups(own: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(own, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(own[order])) + 1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)])


class CentroidGraph:
    """A neighbourhood graph over centroids, walked best first for many vectors at once."""

    def __init__(self, c: np.ndarray):
        self.c = c
        self.half = (c * c).sum(1) / 2
        k = min(DEGREE + 1, len(c))
        near = [np.argpartition(self.half - c[a : a + 1024] @ c.T, k - 1, axis=1)[:, :k] for a in range(0, len(c), 1024)]
        self.edges = np.concatenate(near) if near else np.zeros((0, k), int)
        # A few centroids far apart are where walks begin.
        step = max(1, int(math.sqrt(len(c))))
        self.starts = np.arange(0, len(c), step)

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, want) centroid numbers, nearest first, and squared distances; padded by -1 and infinity."""
        n, m = len(q), len(self.c)
        if 2 * want > BEAM:  # so many that measuring all is cheaper than a walk
            val = self.half - q @ self.c.T
            ids = np.argsort(val, axis=1, kind="stable")[:, :want]
            return ids, np.maximum(2 * np.take_along_axis(val, ids, 1) + (q * q).sum(1)[:, None], 0)
        beam = max(BEAM, want)
        score = lambda rows, ids: self.half[ids] - np.einsum("ij,ij->i", q[rows], self.c[ids])
        seen = np.zeros((n, m), bool)
        ids = np.full((n, beam), -1)
        val = np.full((n, beam), np.inf)
        open_ = np.zeros((n, beam), bool)

        def merge(rows: np.ndarray, new_ids: np.ndarray, new_val: np.ndarray) -> None:
            nonlocal ids, val, open_
            order = np.argsort(rows, kind="stable")
            rows, new_ids, new_val = rows[order], new_ids[order], new_val[order]
            count = np.bincount(rows, minlength=n)
            width = int(count.max()) if len(rows) else 0
            if not width:
                return
            at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            pi, pv = np.full((n, width), -1), np.full((n, width), np.inf)
            pi[rows, at], pv[rows, at] = new_ids, new_val
            ai, av = np.concatenate([ids, pi], 1), np.concatenate([val, pv], 1)
            ao = np.concatenate([open_, pi >= 0], 1)
            best = np.argsort(av, axis=1, kind="stable")[:, :beam]
            ids, val, open_ = (np.take_along_axis(z, best, 1) for z in (ai, av, ao))

        rows = np.repeat(np.arange(n), len(self.starts))
        first = np.tile(self.starts, n)
        seen[:, self.starts] = True
        merge(rows, first, score(rows, first))
        while open_.any():
            # The best few unexpanded candidates of each vector go on.
            rank = np.cumsum(open_, axis=1)
            go = open_ & (rank <= 8)
            rows, cols = np.nonzero(go)
            open_ = open_ & ~go
            to = self.edges[ids[rows, cols]]
            rows = np.repeat(rows, to.shape[1])
            pair = np.unique(rows * m + to.ravel())
            rows, to = pair // m, pair % m
            new = ~seen[rows, to]
            rows, to = rows[new], to[new]
            seen[rows, to] = True
            merge(rows, to, score(rows, to))
        d = 2 * val[:, :want] + (q * q).sum(1)[:, None]
        return ids[:, :want], np.maximum(d, 0)


def file_under(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors (places) go to which lists: the nearest, and others across a close boundary."""
    near, d = graph.search(x, COPIES * 2)
    rows, lists = [np.arange(len(x))], [near[:, 0]]
    chosen = near[:, :1]
    for k in range(1, near.shape[1]):
        c = near[:, k]
        ok = (c >= 0) & (np.sqrt(d[:, k]) <= REPLICA * np.sqrt(d[:, 0])) & ((chosen >= 0).sum(1) < COPIES)
        for j in range(chosen.shape[1]):  # a centroid behind a chosen one adds little
            o = chosen[:, j]
            gap = self_gap(graph.c, c, o)
            ok &= (o < 0) | (gap >= d[:, k] * 0.25)
        rows.append(np.flatnonzero(ok))
        lists.append(c[ok])
        chosen = np.concatenate([chosen, np.where(ok, c, -1)[:, None]], 1)
    return np.concatenate(rows), np.concatenate(lists)


def self_gap(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between centroids ``a`` and ``b``, place by place."""
    return ((c[a] - c[b]) ** 2).sum(1)


def probes(graph: CentroidGraph, q: np.ndarray, held: np.ndarray, need: int, most: int = PROBES, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray]:
    """Which queries (places) probe which lists; ``held``: rows at home in each list.

    The limits act only beyond the lists that together hold ``need`` rows.
    """
    near, d = graph.search(q, most)
    inside = np.where(near >= 0, held[near], 0)
    before = np.cumsum(inside, axis=1) - inside
    ok = (near >= 0) & ((before < need) | (np.sqrt(d) <= ratio * np.maximum(np.sqrt(d[:, :1]), 1e-12)))
    short = np.flatnonzero(inside.sum(axis=1) < need)
    rows, cols = np.nonzero(ok)
    lists = near[rows, cols]
    if len(short):  # those take lists until they have enough, whatever the limits
        full = np.argsort(graph.half - q[short] @ graph.c.T, axis=1, kind="stable")
        inside = held[full]
        more, cols = np.nonzero(np.cumsum(inside, axis=1) - inside < need)
        pair = np.unique(np.concatenate([rows * len(graph.c) + lists, short[more] * len(graph.c) + full[more, cols]]))
        rows, lists = pair // len(graph.c), pair % len(graph.c)
    return rows, lists


def reach(graph: CentroidGraph, q: np.ndarray, near: list[np.ndarray], lists: dict[int, list[int]], recall: float = RECALL) -> tuple[int, float]:
    """Lists and distance ratio at which queries ``q`` find a share ``recall`` of the ids ``near`` them.

    ``lists`` are those an id is filed under.  Half of what may be lost goes to either limit.
    """
    order, d = graph.search(q, max(BEAM, len(graph.c)))
    place = np.argsort(order, axis=1)
    ranks, ratios = [], []
    for i, ids in enumerate(near):
        for x in ids:
            at = int(place[i, lists[x]].min())
            ranks.append(at + 1)
            ratios.append(math.sqrt(d[i, at] / d[i, 0]) if d[i, 0] > 0 else (1.0 if d[i, at] <= 0 else math.inf))
    if not ranks:
        return PROBES, RATIO
    share = 1 - (1 - recall) / 2
    some = np.quantile(ratios, share, method="higher")
    return max(PROBES, int(np.quantile(ranks, share, method="higher"))), max(RATIO, float(some) * (1 + 1e-9))


def clean_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part, components as doubles."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def search(vectors: DataFrame, query_mod: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for every id divisible by ``query_mod``."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    clean = clean_vectors(vectors, id_col, vec_col)
    head = clean.agg(F.min_by(F.size("v"), "vec_id").alias("dims"), F.count(F.lit(1)).alias("n")).first()
    if not head.n:
        return spark.createDataFrame([], out)
    clean = written(clean.filter(F.size("v") == head.dims).withColumn("h", F.xxhash64("v")).distinct(), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most = clean.agg(F.max(square)).first()[0]

    # One row per vector, with its smallest ids; rows of equal vectors are cut before they are shuffled.
    kk = k + 1
    among = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    least = clean.withColumn("among", among).filter(F.col("among") <= kk)
    grouped = least.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    uniq = written(grouped.withColumn("key", F.monotonically_increasing_id()).withColumn("first", F.col("ids")[0]), "distinct-vectors")
    n = uniq.count()
    # Queries of one vector ask once; an id of several vectors asks for itself, as those that only it holds are none of its candidates.
    wanted = clean.filter(F.col("vec_id") % query_mod == 0)
    several = wanted.groupBy("vec_id").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("vec_id", F.lit(True).alias("lone"))
    asking = wanted.join(several, "vec_id", "left").join(uniq.select("h", "v", "key"), ["h", "v"])
    asking = written(asking.select(F.col("vec_id").alias("query_id"), "key", F.coalesce("lone", F.lit(False)).alias("lone"), F.when(F.col("lone"), F.col("vec_id")).otherwise(0).alias("own")), "asking")
    asks_ = written(asking.select("key", "lone", "own").distinct().withColumn("query", F.monotonically_increasing_id()), "asks")
    members = asking.join(asks_, ["key", "lone", "own"]).select("query_id", "query")
    queries = asks_.join(uniq.select("key", "v"), "key").select("query", "lone", "own", "v")
    vectors_ = uniq.select("key", (F.size("ids") == 1).alias("one"), "first", "v")

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])

    def matrix(col: pa.Array) -> np.ndarray:
        return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)

    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * head.dims), n))
    sample = matrix(sample_by_hash(vectors_, "key", rows, "ann").select("v").toArrow().column(0).combine_chunks())  # bounded in rows and bytes
    lists = int(max(1, min(MAX_LISTS, n // LIST_ROWS, len(sample) // 4)))
    centroids = spark.sparkContext.broadcast(balanced_centroids(lifted(sample), lists))
    del sample

    def filed(batches: Iterator[pa.RecordBatch], asks: bool) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(centroids.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                s = b.slice(lo, 1024)
                x = matrix(s.column(3))
                rows, lists_ = probes(graph, np.column_stack([x, np.zeros(len(x))]), held, ENOUGH * k, most_probes, ratio) if asks else file_under(graph, lifted(x))
                take = pa.array(rows)
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(lists_.astype(np.int64)), *(s.column(j).take(take) for j in range(3)), packed.take(take), pa.array(np.arange(len(rows)) < len(x))], ["list", *s.schema.names[:3], "v", "home"])

    shape = "list long, key long, one boolean, first long, v binary, home boolean"
    posts = written(vectors_.mapInArrow(lambda it: filed(it, False), shape), "postings")
    # Every vector is at home in one list, so those at home in different lists are different candidates.
    held = np.zeros(len(centroids.value), np.int64)
    for r in posts.filter("home").groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per list
        held[r.list] = r.n

    # Sample queries by brute force over all rows: a partition sends at most k + 1 rows for each.
    trial = {r.query: r.v for r in sample_by_hash(queries, "query", TRIALS, "trial").collect()}  # bounded by TRIALS
    trial_ids, trial_v = np.array(list(trial), np.int64), np.array(list(trial.values()), np.float64)

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0))] * len(trial_ids)
        for b in batches:
            x, ids = matrix(b.column(3)), b.column(0).to_numpy()
            score = trial_v @ x.T
            for i, s in enumerate(score):
                some = np.argpartition(-s, kk - 1)[:kk] if len(s) > kk else np.arange(len(s))
                all_ids, all_s = np.append(held[i][0], ids[some]), np.append(held[i][1], s[some])
                top = np.argsort(-all_s, kind="stable")[:kk]
                held[i] = all_ids[top], all_s[top]
        for own, (ids, s) in zip(trial_ids, held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), own)), pa.array(ids), pa.array(s)], ["query", "key", "score"])

    most_probes, ratio = PROBES, RATIO
    if len(trial):
        top = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        true = vectors_.mapInArrow(truth, "query long, key long, score double").withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= kk).select("query", "key")
        where = true.join(posts.select("key", "list"), "key").groupBy("query", "key").agg(F.collect_set("list").alias("lists")).collect()  # TRIALS times k + 1 rows
        near: dict[int, list[int]] = {q: [] for q in trial}
        for r in where:
            near[r.query].append(r.key)
        most_probes, ratio = reach(CentroidGraph(centroids.value), np.column_stack([trial_v, np.zeros(len(trial_v))]), list(near.values()), {r.key: r.lists for r in where})
    asked = written(queries.mapInArrow(lambda it: filed(it, True), "list long, query long, lone boolean, own long, v binary, home boolean"), "probes")

    # Long lists are cut into blocks, and so are the queries of a list; every two blocks meet in a task.
    # One row per list: their number is bounded by MAX_LISTS and its splits.
    sizes = posts.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The ``k + 1`` best vectors of a block for each query of a block; a vector is once in a list."""
        frames = []
        if len(left) and len(right):
            x = np.frombuffer(b"".join(left["v"]), np.float64).reshape(len(left), -1)
            ids, firsts, one = left["key"].to_numpy(), left["first"].to_numpy(), left["one"].to_numpy(bool)
            for lo in range(0, len(right), 512):
                part = right.iloc[lo : lo + 512]
                q = np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), -1)
                for qid, lone, own, qv, s in zip(part["query"].tolist(), part["lone"], part["own"], q, q @ x.T):
                    if lone:
                        s = np.where(one & (firsts == own), -np.inf, s)
                    if len(s) > kk:
                        edge = np.partition(s, len(s) - kk)[len(s) - kk]
                        some = np.flatnonzero(s >= edge - 1e-9 * abs(edge) - 1e-300)
                    else:
                        some = np.arange(len(s))
                    some = some[s[some] > -np.inf]
                    # The exact score is summed component by component, alike in every block.
                    exact = (x[some] * qv).cumsum(axis=1)[:, -1]
                    top = np.lexsort((firsts[some], -exact))[:kk]
                    frames.append(pd.DataFrame({"query": qid, "key": ids[some][top], "first": firsts[some][top], "score": exact[top]}))
        return pd.concat(frames) if frames else pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("query", "int64"), ("key", "int64"), ("first", "int64"), ("score", "float64"))})

    def answers(ask: DataFrame) -> DataFrame:
        """``query, key, first, score, rank``: the ``k + 1`` best vectors of each query vector."""
        shares = ask.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("shares")).join(F.broadcast(sizes), "list")  # a row per list
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        post = posts.join(F.broadcast(shares), "list").select("list", own("key", "blocks").alias("block"), each("shares").alias("share"), "key", "one", "first", "v")
        asks = ask.join(F.broadcast(shares), "list").select("list", each("blocks").alias("block"), own("query", "shares").alias("share"), "query", "lone", "own", "v")
        by = ["list", "block", "share"]
        found = post.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(best, "query long, key long, first long, score double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))
        return found.dropDuplicates(["query", "key"]).withColumn("rank", rank).filter(F.col("rank") <= kk)

    near = written(answers(asked), "answers")
    # Queries whose lists held too few vectors ask all lists.
    full = near.filter(F.col("rank") == kk).select("query")
    short = asked.join(full, "query", "left_anti").select("query", "lone", "own", "v").distinct()
    if not short.isEmpty():
        second = answers(short.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(held) - 1).cast("long")))))
        near = near.join(full, "query", "left_semi").select(second.columns).unionByName(second)
    # Back to ids: every row that asks with a vector leaves out its own.
    told = near.select("query", "key", "score").join(uniq.select("key", "ids"), "key").join(members, "query")
    pairs = told.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("query_id <> vec_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
