"""Encoder, packing and token files against the tokenizers library itself."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heronsift.llm import packing, token_files
from heronsift.llm.common import new_path
from heronsift.llm.tokens import ChunkEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "Foo, foo. FOO!! It's a test", "ΑΣ é ́x\x85 \x1c y", "<|endoftext|> z", "word " * 9000, "a", "日本 語​ x﻿", "it's 3a's 1234 !!?? x\n\n  y"] + [f"doc number {i} " * (i % 50 + 1) for i in range(120)]


@pytest.mark.parametrize("path,spaces", [(WORD, False), (BYTE, True)])
def test_encoder_equals_library(path, spaces):
    enc, own = ChunkEncoder(path, spaces, memo_entries=40), Tokenizer.from_file(path)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.text(st.sampled_from(list("aBéß .,!'\n\t\u00a0\u3000\u2009\x1c\u0301<|>3İǅ日$×Ġľ( "))), max_size=6))
    def check(texts):
        for t, ids in zip(texts, enc.encode_many(texts)):
            assert ids.tolist() == own.encode(t, add_special_tokens=False).ids

    check()
    odd = ["a\u00a0 b", "\u3000 x", "é, ×. ÷! ñ; ľ: e\u0301,", "a\u2003 \u2009b", "x\x1f y", "don't, 'tis", "a." * 300, " \n ", "tail \u00a0", "in \u0120 q", "İstanbul, k"]
    for t, ids in zip(odd, enc.encode_many(odd)):
        assert ids.tolist() == own.encode(t, add_special_tokens=False).ids
    for t, ids in zip(TEXTS, enc.encode_many(TEXTS)):
        assert ids.tolist() == own.encode(t or "", add_special_tokens=False).ids


def docs(spark, texts=TEXTS):
    rows = [(k if k != 3 else None, t, 1, "q") for k, t in enumerate(texts)] + ([(5, texts[5], 1, "q")] if texts else [])
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string").repartition(4)


def ids_of(path, text, end):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("windows,merged", [(64, 32), (2, 1)])
def test_pack(spark, windows, merged):
    got = packing.pack(docs(spark), WORD, open_windows=windows, merged_tasks=merged).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    padding = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.05 * sum(r.length for r in got)
    for k, t in enumerate(TEXTS):
        key = None if k == 3 else k
        ids, at = ids_of(WORD, t, 1), 0
        rows = sorted(by_doc[key], key=lambda r: r.start)
        if k == 5:
            assert sum(r.length for r in rows) == 2 * len(ids)
            continue
        for r in rows:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_pack_nothing(spark):
    assert packing.pack(docs(spark, []), WORD).count() == 0


def test_token_files_round_trip(spark):
    path = new_path(spark, "tf")
    token_files.write_token_files(docs(spark), path, BYTE)
    got = sorted(token_files.digest_token_files(spark, path).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: -1 if d is None else d) and len(order) == len(TEXTS) + 1
    at = 0
    for r in got:
        ids = ids_of(BYTE, TEXTS[3 if r.doc_id is None else r.doc_id], 0)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    whole = {r.start: r.ids for r in token_files.read_token_files(spark, path).collect()}
    assert bytes(whole[0]) == ids_of(BYTE, TEXTS[3], 0).tobytes()
    assert spark.read.parquet(f"{path}/dictionary").first().dictionary
    some = token_files.read_documents(spark, path, [0, 6, 40, 10**9]).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {k: ids_of(BYTE, TEXTS[k], 0).tobytes() for k in (0, 6, 40)} and len(some) == 3


def test_an_id_of_very_many_rows_is_spread(spark):
    rows = [(7 if k % 2 else (None if k % 3 else k), f"text {k} " * 5, 1, "q") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string").repartition(4)
    path = new_path(spark, "tf")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        token_files.write_token_files(df, path, BYTE)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    got = sorted(token_files.digest_token_files(spark, path).collect(), key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(got) == 600
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    held = [r.n for r in spark.read.parquet(f"{path}/frames").groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert max(held) <= 150


def test_a_wider_vocabulary_takes_four_bytes(spark):
    path = new_path(spark, "tf")
    token_files.write_token_files(docs(spark, TEXTS[:9]), path, BYTE, end_id=70_000)
    assert spark.read.parquet(f"{path}/dictionary").first().width == 4
    assert sorted(r.n_tokens for r in token_files.digest_token_files(spark, path).collect()) == sorted(len(ids_of(BYTE, t, 0)) for t in [*TEXTS[:9], TEXTS[5]])


def test_token_files_of_nothing(spark):
    path = new_path(spark, "tf")
    token_files.write_token_files(docs(spark, []), path, BYTE)
    assert token_files.digest_token_files(spark, path).count() == 0
