"""Near copies, passages, neighbours and the pipeline against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from heronsift.llm import ann, near_copies, simhash, substring_dedup
from heronsift.llm.components import connected_components

DOCS = "doc_id long, text string, fp string, keeper int, hash long"
RNG = random.Random(11)


def words(n):
    return [f"w{RNG.randrange(10**6)}" for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS).repartition(3)


def classes(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_components(spark):
    edges = [(RNG.randrange(60), RNG.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 200 + i) for i in range(50)] + [(5, 5), (None, 3)]
    want = classes(300, [e for e in edges if None not in e])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").dropna()).collect()}
    seen = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: want[x] for x in seen}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_simhash(text, w=3):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    found = (text or "").encode().translate(low).split()
    if not found:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(found[i : i + w]), 42) for i in range(max(1, len(found) - w + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a"), (4, "A"), (5, "a b"), (6, "é É")]
    for i in range(12):
        base = words(900)
        rows.append((100 + 10 * i, " ".join(base)))
        for j in range(1, 5):
            base = list(base)
            base[RNG.randrange(900)] = "changed"
            rows.append((100 + 10 * i + j, " ".join(base)))
    rows += [(None, rows[10][1]), rows[10], (500, "x " * 60_000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [plain_simhash(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    cls = classes(len(rows), near)
    name = {c: min(i for (i, _), k in zip(rows, cls) if k == c and i is not None) for c in set(cls)}
    want = sorted((-1 if i is None else i, f, name[c]) for (i, _), f, c in zip(rows, fps, cls))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert len(near) > 20
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 5)
    fps = {(RNG.getrandbits(64)) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            g = f
            for _ in range(RNG.randint(1, 4)):
                g ^= 1 << RNG.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    want = classes(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    place = {f: k for k, f in enumerate(signed)}
    edges = [(place[r.a], place[r.b]) for r in simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert classes(len(fps), edges) == want and len(edges) < 20 * len(fps)


def shingle_set(text, w=5):
    found = (text or "").lower().split()
    return {tuple(found[i : i + w]) for i in range(max(1, len(found) - w + 1))} if found else set()


@pytest.mark.parametrize("share", [50_000, 6])
def test_near_copies_by_similarity(spark, monkeypatch, share):
    monkeypatch.setattr(near_copies, "SHARE_ROWS", share)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a"), (4, "A"), (5, "a b"), (6, "a b c d e"), (500, "x " * 60_000)]
    for i in range(40):  # families of texts that drift from one another, short and long
        base = words(RNG.choice([30, 80, 300, 900]))
        rows.append((1000 + 10 * i, " ".join(base)))
        for j in range(1, 9):
            base = list(base)
            for _ in range(max(1, len(base) // RNG.choice([40, 80, 300]))):
                base[RNG.randrange(len(base))] = RNG.choice("pqrstu") + str(j)
            rows.append((1000 + 10 * i + j, "  ".join(base)))
    rows += [(None, rows[12][1]), rows[12]]
    sets = [shingle_set(t) for _, t in rows]
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
    pairs = [(a, b, like(a, b)) for a in range(len(rows)) for b in range(a)]
    sure, may = classes(len(rows), [p[:2] for p in pairs if p[2] >= 0.88]), classes(len(rows), [p[:2] for p in pairs if p[2] >= 0.72])
    kept = near_copies.drop_near_copies(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    found = [r.doc_id for r in kept.collect()]
    place = {i: k for k, (i, _) in enumerate(rows) if i is not None}
    assert len(found) == len(set(found)) and len({sure[place[i]] for i in found}) == len(found)  # no two sure copies stay
    assert {may[place[i]] for i in found} == set(may)  # each group keeps one at least
    assert len([p for p in pairs if 0.8 <= p[2] < 1]) > 40
    assert near_copies.drop_near_copies(docs(spark, [])).count() == 0


def test_sketches_estimate_similarity():
    worst = 0.0
    for n in (3, 40, 400, 4000):
        for share in (0.0, 0.5, 0.7, 0.8, 0.9, 1.0):
            same = int(n * share)
            hashes = np.array([RNG.getrandbits(64) for _ in range(2 * n)], np.uint64)
            a, b = np.unique(hashes[:n]), np.unique(np.concatenate([hashes[:same], hashes[n : 2 * n - same]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got = near_copies.estimates(near_copies.sketch(a)[0][None], near_copies.sketch(b)[0][None])[0]
            worst = max(worst, abs(got - true))
    assert worst < 0.12


def test_passages(spark):
    shared, rows = words(80), []
    for i in range(30):
        own = words(150)
        if i % 3 == 0:  # a fuzzy copy of one passage in every third text
            copy = list(shared)
            for k in RNG.sample(range(80), 4):
                copy[k] = "edited"
            own[40:40] = copy
        rows.append((i, (" " if i % 2 else "  \n").join(own)))
    rows += [(90, None), (91, ""), (92, "short text"), (None, rows[0][1]), (93, "same words " * 20_000), (95, "same words " * 300), (94, " ".join(words(300))), (94, " ".join(words(300)))]
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    flagged = {r.doc_id for r in got} | {r.other_id for r in got}
    assert flagged == {i for i in range(30) if i % 3 == 0} and {r.class_id for r in got} == {0}
    for r in got:
        assert 40 <= r.length <= 95 and 25 <= r.start and r.start + r.length <= 140 and r.similarity >= 0.8
    _, covered = joined(got)
    assert all(len(covered[i]) >= 60 for i in range(0, 30, 3))
    assert substring_dedup.repeated_passages(docs(spark, [])).count() == 0


def test_chains_equal_quadratic_search():
    for _ in range(30):
        pts = sorted({(RNG.randrange(120), RNG.randrange(120)) for _ in range(40)})
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        best = []
        for i in range(len(pts)):
            before = [best[j] - substring_dedup.GAP * (x[i] - x[j] + y[i] - y[j]) / 2 for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best.append(substring_dedup.K + max([0.0, *before]))
        c = substring_dedup.chains(x, y)[0]
        end = pts.index((c[1] - substring_dedup.K, c[3] - substring_dedup.K))
        assert best[end] == pytest.approx(max(best))


def test_two_passages_about_unlike_words(spark):
    # A common header and footer of 55 words about own words, in two documents each.
    rows, want = [], set()
    for i, gap in enumerate([20, 40, 60, 100, 150, 200, 300] * 3):
        head, foot = words(55), words(55)
        rows += [(2 * i + j, " ".join(words(30) + head + words(gap) + foot + words(30))) for j in range(2)]
        want |= {(2 * i, 30 + k) for k in range(55)} | {(2 * i, 85 + gap + k) for k in range(55)}
    got = substring_dedup.passages(docs(spark, rows)).collect()
    covered = {(min(r.doc_id, r.other_id), w) for r in got for w in range(r.start, r.start + r.length)}
    assert want <= covered and all(abs(r.doc_id - r.other_id) == 1 and r.similarity >= 0.8 for r in got)


def joined(got):
    """Class by document, and the words of each that passages cover."""
    cls, covered = {}, {}
    for r in got:
        cls[r.doc_id] = cls[r.other_id] = r.class_id
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
        covered.setdefault(r.other_id, set()).update(range(r.other_start, r.other_start + r.other_length))
    return cls, covered


@pytest.mark.parametrize("parts", [1, 5])
def test_a_passage_whose_pieces_stand_elsewhere(spark, parts):
    # Earlier documents hold 15- and 30-word pieces of what 50 and 51 share.
    shared = words(80)
    rows = [(k, " ".join(words(40) + shared[15 * k : 15 * k + 15] + words(40))) for k in range(5)]
    rows += [(10 + k, " ".join(words(40) + shared[30 * k : 30 * k + 30] + words(40))) for k in range(2)]
    rows += [(50, " ".join(words(20) + shared + words(20))), (51, " ".join(words(33) + shared + words(7)))]
    got = substring_dedup.repeated_passages(docs(spark, rows).repartition(parts)).collect()
    cls, covered = joined(got)
    assert set(cls) == {50, 51} and cls[50] == cls[51]
    assert set(range(20, 100)) <= covered[50] and set(range(33, 113)) <= covered[51]


def test_a_passage_twice_in_a_document(spark):
    shared = words(60)
    rows = [(1, " ".join(words(10) + shared + words(10))), (2, " ".join(shared + words(70) + shared + words(5))), (7, " ".join(words(300)))]
    rows += [(3, " ".join(shared + words(50) + shared)), (4, " ".join(words(30)))]
    cls, covered = joined(substring_dedup.repeated_passages(docs(spark, rows)).collect())
    assert set(cls) == {1, 2, 3}
    assert set(range(60)) <= covered[2] and set(range(130, 190)) <= covered[2] and set(range(110, 170)) <= covered[3]
    # The first holder's own second place, too.
    rows = [(1, " ".join(shared + words(70) + shared)), (2, " ".join(words(20) + shared))]
    _, covered = joined(substring_dedup.repeated_passages(docs(spark, rows)).collect())
    assert set(range(60)) <= covered[1] and set(range(130, 190)) <= covered[1]


def test_classes_of_exact_passages_equal_brute_force(spark):
    # Random documents out of a few pieces: any 60 words in a row that two share join them.
    RNG.seed(4)
    pool = [words(RNG.choice([10, 25, 35, 60, 90])) for _ in range(25)]
    rows = []
    for i in range(60):
        text = words(15)
        for _ in range(RNG.randrange(1, 4)):
            p = RNG.choice(pool)
            a = RNG.randrange(0, max(1, len(p) - 60) + 1)
            text += p[a : a + RNG.choice([20, 60, 90])] + words(RNG.choice([3, 30]))
        rows.append((i, " ".join(text)))
    runs = [{tuple(t.split()[k : k + 60]) for k in range(len(t.split()) - 59)} for _, t in rows]
    must = [(a, b) for a in range(60) for b in range(a) if runs[a] & runs[b]]
    short = [{tuple(t.split()[k : k + 20]) for k in range(len(t.split()) - 19)} for _, t in rows]
    may = classes(60, [(a, b) for a in range(60) for b in range(a) if short[a] & short[b]])
    cls, _ = joined(substring_dedup.repeated_passages(docs(spark, rows)).collect())
    assert len(must) > 10 and all(cls[a] == cls[b] for a, b in must)
    assert all(may[a] == may[b] for a in cls for b in cls if cls[a] == cls[b])


@pytest.mark.parametrize("holders", [1, 5, 40])
@pytest.mark.parametrize("parts", [1, 5])
def test_a_changed_passage_whose_pieces_stand_elsewhere(spark, parts, holders):
    # 900 and 901 share 90 words, one in 15 changed; other documents hold each of the unchanged pieces.
    shared = words(90)
    copy = [w if k % 15 else "changed" for k, w in enumerate(shared)]
    rows = [(40 * k + j, " ".join(words(40) + shared[15 * k + 1 : 15 * k + 15] + words(40))) for k in range(6) for j in range(holders)]
    rows += [(900, " ".join(words(20) + shared + words(20))), (901, " ".join(words(33) + copy + words(7)))]
    got = substring_dedup.repeated_passages(docs(spark, rows).repartition(parts)).collect()
    cls, covered = joined(got)
    assert set(cls) == {900, 901} and cls[900] == cls[901] == 900
    assert set(range(22, 110)) <= covered[900] and set(range(35, 123)) <= covered[901]


@pytest.mark.parametrize("cuts", [2, 7, 1000])
def test_holders_met_in_parts(cuts):
    # Rows of few holders meet each other, those of many the first; however they come in batches.
    rows = sorted((h, RNG.randrange(12), RNG.randrange(400)) for h, n in [(1, 5), (2, 16), (3, 17), (4, 60), (5, 1), (6, 2), (9, 16)] for _ in range(n))
    names = ["hash", "doc", "pos", "last", "kind", "often", "rep", "rep_pos", "rep_last"]
    cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[2] for r in rows], [0] * len(rows), [False] * len(rows), *([[None] * len(rows)] * 3)]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]
    table = pa.table([pa.array(c, t) for c, t in zip(cols, types)], names)
    out = [r for b in substring_dedup._match_rows(iter(table.to_batches(max_chunksize=cuts))) for r in b.to_pylist()]
    got = {((r["hash"], r["doc"], r["pos"]), (r["rep"], r["rep_pos"])) for r in out}
    for h in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == h]
        of = {(a, b) for a, b in got if a[0] == h}
        if len(own) <= substring_dedup.MEET:
            assert of == {(a, b[1:]) for n, a in enumerate(own) for b in own[:n] if a[1] != b[1]}
        else:
            assert {a for a, _ in of} >= set(own[1:]) and all(a[1] != b[0] for a, b in of)


def seed_values(rows, bits=4):
    table = pa.table([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc", "text"])
    return [b for b in substring_dedup._seed_rows(iter(table.to_batches()), bits)]


def test_seeds_cross_a_shuffle_packed():
    # One value per bucket and chunk, not one row per seed; zlib stands for the shuffle's compression.
    rows = [(i, " ".join(words(500))) for i in range(200)]
    want = sorted((int(h), i, int(p)) for i, t in rows for h, p in zip(*substring_dedup.seeds(substring_dedup.word_hashes(t))))
    values = [x.as_buffer() for b in seed_values(rows) for x in b.column(2)]
    assert len(values) <= 16 and len(want) > 20_000
    assert sum(len(zlib.compress(x, 1)) for x in values) < 15 * len(want)
    h, doc, pos = substring_dedup._unpacked(values, substring_dedup._OPEN)[:3]
    assert sorted(zip(h.tolist(), doc.tolist(), pos.tolist())) == want


def test_met_rows_do_not_hang_on_their_order():
    # Places of a frequent couple tie in all but their ends: the others meet the first document's nearest one.
    rows = [(5, doc, 7, last) for doc in range(12) for last in (27, 30, 33)]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        h, doc, pos, last = (np.array(x) for x in zip(*rows))
        cols = [h.astype(np.uint64), doc, pos, last, np.full(len(h), substring_dedup.COUPLE), np.zeros(len(h), bool)]
        batches = [b for k in range(0, len(h), 9) for b in substring_dedup._by_bucket(cols[0][k : k + 9], [x[k : k + 9] for x in cols], substring_dedup._OPEN, 4)]
        values = [x.as_buffer() for b in substring_dedup._met_rows(iter(batches)) for x in b.column(0)]
        got = {x[1:4] + x[6:] for x in zip(*(c.tolist() for c in substring_dedup._unpacked(values, substring_dedup._MATCH)))}
        assert got == {(d, 7, e, 0, 7, 27) for _, d, _, e in rows if d} | {(0, 7, e, 1, 7, 27) for e in (30, 33)}


def test_points_in_one_number_equal_triples():
    rng = np.random.default_rng(2)
    for top in (9, 1 << 30):  # the latter take more than 64 bits
        pair, x, y = (rng.integers(0, n, 500) for n in (7, top, top))
        x[-1] = y[-1] = top - 1
        pair, x, y = (np.concatenate([c, c[:200]]) for c in (pair, x, y))
        got = substring_dedup._points(pair, x, y)
        assert list(zip(*(c.tolist() for c in got))) == sorted({*zip(pair.tolist(), x.tolist(), y.tolist())})


@pytest.mark.parametrize("unit", [True, False])
def test_neighbours(spark, unit):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.5 * rng.normal(size=(900, 16))
    x = x / np.linalg.norm(x, axis=1)[:, None] if unit else x
    x = x.astype(np.float32)
    x[100:200] = x[100]
    rows = [(i, [float(v) for v in r], 0, 1) for i, r in enumerate(x)]
    odd = [(1000, None, 0, 1), (1020, [0.0] * 16, 0, 1), (1040, [float("nan")] + [0.1] * 15, 0, 1), (1060, [None] + [0.1] * 15, 0, 1), (1080, [float("inf")] * 16, 0, 1), (None, rows[3][1], 0, 1), (1100, [1.0], 0, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int, list int").repartition(4)
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d, found = x.astype(float), 0
    assert set(got) == {i for i in range(900) if i % 20 == 0}
    for q, hits in got.items():
        s = d @ d[q]
        order = [i for i in np.lexsort((np.arange(900), -np.round(s, 12))) if i != q][:20]
        assert [h[0] for h in hits] == list(range(1, 21)) and all(h[2] == pytest.approx(s[h[1]], abs=1e-12) for h in hits)
        found += len({h[1] for h in hits} & set(map(int, order)))
    assert found / (20 * len(got)) >= 0.9
    assert ann.search(df.limit(0)).count() == 0


def test_probes_grow_with_lists(spark, monkeypatch):
    # 48 of some 600 lists hold too few neighbours of vectors without clusters.
    monkeypatch.setattr(ann, "LIST_ROWS", 10)
    x = np.random.default_rng(3).normal(size=(6000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, query_mod=30).toPandas().groupby("query_id")["vec_id"].agg(set)
    found = 0
    for q, hits in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        found += len(hits & set(np.argsort(-s)[:20].tolist()))
    assert found / (20 * 200) >= 0.9


def test_every_query_gets_k_rows(spark, monkeypatch):
    # Tight copies with a list of their own, an id of many rows, and one row many times.
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    rng = np.random.default_rng(8)
    rows = [(1000 + i, v) for i, v in enumerate(rng.normal(size=(1500, 8)))]
    for j in range(6):
        far = 8 * rng.normal(size=8)
        rows += [(20 * j + m, far + 1e-7 * rng.normal(size=8)) for m in range(7)]
    twin = 9 * rng.normal(size=8)
    rows += [(500, twin + 0.01 * rng.normal(size=8)) for _ in range(200)]
    rows += [(501, twin)] * 60 + [(3000 + i, 9 * np.ones(8)) for i in range(300)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df).toPandas().groupby("query_id").size()
    assert set(got.index) == {i for i, _ in rows if i % 20 == 0} and (got == 20).all()


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [0.5, 0.5]), (21, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = ann.search(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 21), (0, 2, 20), (20, 1, 21), (20, 2, 0)]
