"""The pipeline stage by stage against plain versions, and on awkward tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path as vocabulary
from tokenizers import Tokenizer

import corpus_pipeline
from heronsift.llm import quality

RNG = random.Random(21)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hs_key0 int, node double, e string, hs_mix_row int, c0 string"
EXTRA = ("s", 1, 0.5, "e", 2, "c")


def words(n):
    return [f"w{RNG.randrange(10**6)}" for _ in range(n)]


def tables(spark, folder, rows, labels):
    spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def shingles(text, w=5):
    found = (text or "").lower().split()
    return {tuple(found[i : i + w]) for i in range(max(1, len(found) - w + 1))} if found else set()


def test_stages(spark, tmp_path):
    rows = [(i, " ".join(words(60)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " ", "en", "s0", 1) for i in range(10)]  # equal without white space, more code points
    rows += [(300 + i, " ".join(["new", *rows[20 + i][1].split()[1:]]), "en", "s1", 1) for i in range(10)]  # near copies
    rows += [(200, None, None, None, None), (None, "", "en", None, 0), (400, "long words " * 30_000, "en", "s2", 1), (5, rows[5][1], "en", "s2", 1)]
    docs = tables(spark, tmp_path, rows, [(i, 1, 0) for i in range(40)] + [(40 + i, int(i % 2), 0) for i in range(20)])
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    text = {r[0]: r[1] for r in rows}

    good = corpus_pipeline.keep_good(spark, docs, str(tmp_path))
    scores = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    assert good.columns == docs.columns
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r[0]) for r in rows if scores[r[0]] >= corpus_pipeline.KEEP_FROM)

    distinct = corpus_pipeline.keep_distinct(spark, docs, str(tmp_path))
    want = {}
    for r in rows:
        key = "".join((r[1] or "").split())
        best = want.get(key)
        rank = lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0)
        want[key] = r if best is None or rank(r) < rank(best) else best
    assert distinct.columns == docs.columns and sorted(str(r.doc_id) for r in distinct.collect()) == sorted(str(r[0]) for r in want.values())
    assert {tuple(r)[5:] for r in distinct.collect()} == {EXTRA}

    unlike = corpus_pipeline.keep_unlike(spark, distinct, str(tmp_path))
    kept = sorted(want.values(), key=lambda r: (r[0] is None, r[0] or 0))
    stay = []
    for r in kept:
        a = shingles(r[1])
        if not any((not a and not shingles(x[1])) or len(a & shingles(x[1])) >= 0.8 * len(a | shingles(x[1])) > 0 for x in stay):
            stay.append(r)
    assert unlike.columns == docs.columns and sorted(str(r.doc_id) for r in unlike.collect()) == sorted(str(r[0]) for r in stay)
    assert {30, 31} <= {r.doc_id for r in unlike.collect()} and not {300, 309} & {r.doc_id for r in unlike.collect()}

    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    often = {}
    for r in mixed.collect():
        often[(r.doc_id, r.source)] = often.get((r.doc_id, r.source), 0) + 1
    assert max(often.values()) <= 3 and not {(200, None), (None, None)} & set(often)

    packed = corpus_pipeline.pack_tokens(spark, docs, str(tmp_path)).collect()
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for r in packed:
        if r.doc_id not in (5, None):
            ids = np.array([*tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())

    out = corpus_pipeline.run(spark, str(tmp_path))
    ends = out.groupBy("sequence_id").sum("length").collect()
    assert out.count() > 0 and max(r["sum(length)"] for r in ends) <= 2048
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {r[0] for r in stay}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3])
def test_tables_without_text(spark, tmp_path, rows):
    docs = tables(spark, tmp_path, rows, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
