"""Operators without a SQL form, and edge cases, against plain Python."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from heronsift.functions import text as T
from heronsift.operators import chunking as C
from heronsift.operators import metrics as M
from heronsift.operators import retrieval as R
from heronsift.operators import uncertainty as A
from heronsift.sources import chunks as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_incomplete_beta_known_values():
    assert A.incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)
    assert A.incomplete_beta(2, 3, 0.5) == pytest.approx(11 / 16)
    assert A.incomplete_beta(0.5, 0.5, 0.25) == pytest.approx(2 / math.pi * math.asin(0.5))
    assert A.beta_quantile(0.5, 4, 4) == pytest.approx(0.5)


def test_beta_interval(spark):
    r = A.beta_interval(spark.createDataFrame([("a", 8, 10)], "g string, successes long, n long"), 1, 1).first()
    assert A.incomplete_beta(9, 3, r.cri_lo) == pytest.approx(0.025, abs=1e-9)
    assert A.incomplete_beta(9, 3, r.cri_hi) == pytest.approx(0.975, abs=1e-9)
    assert r.posterior_mean == pytest.approx(9 / 12)


def test_dirichlet_mrr_mean(spark):
    df = spark.createDataFrame([("g", 1.0)] * 30 + [("g", 0.5)] * 20 + [("g", 0.0)] * 10, "g string, mrr double")
    r = A.dirichlet_mrr(df, ["g"], draws=20_000).first()
    a, v = [31, 21, 1, 1, 1, 11], [1, 1 / 2, 1 / 3, 1 / 4, 1 / 5, 0]
    exact = sum(x * y for x, y in zip(a, v)) / 66
    sd = math.sqrt((sum(x * y * y for x, y in zip(a, v)) / 66 - exact**2) / 67)
    assert r.mean == pytest.approx(exact, abs=0.002) and r.hi - r.lo == pytest.approx(3.92 * sd, rel=0.05)


def test_zoib_mean(spark):
    df = spark.createDataFrame([("g", x) for x in [0.0, 1.0, 1.0] + [0.2, 0.4, 0.5, 0.6, 0.7] * 20], "g string, y double")
    r = A.zoib_mean(df, "y", ["g"]).first()
    assert (r.zeros, r.ones, r.middle) == (1, 2, 100) and r["mean"] == pytest.approx(0.48, abs=0.03)
    mu, a = r.alpha / (r.alpha + r.beta), [2, 3, 101]
    mean = (a[1] + a[2] * mu) / 106
    sd = math.sqrt(((a[1] + a[2] * mu * mu) / 106 - mean**2) / 107)
    assert r["mean"] == pytest.approx(mean) and r.hi - r.lo == pytest.approx(3.92 * sd, rel=0.1) and r.lo < mean < r.hi
    t = A.ndcg_summary(df, "y", ["g"], draws=1000).first()
    assert len(t) == 13 and t.n == 103 and t.one_rate == pytest.approx(2 / 103) and t.boot_low < t.mean_ndcg < t.boot_high
    p = A.ndcg_pair(df, "y", ["g"], draws=1000).first()
    assert p.ci_low < p.ndcg_mean < p.ci_high and p.cr_low < p.ndcg_mean < p.cr_high


@pytest.mark.parametrize("bayesian", [False, True])
def test_resampling_by_counts(spark, bayesian):
    import numpy as np

    x = np.random.default_rng(4).choice([0.0, 0.2, 0.25, 1 / 3, 0.5, 1.0], 4001)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 0.5), ("b", None)], "g string, y double").repartition(3)
    got = {r.g: r for r in A.resampled(df, "y", ["g"], 4000, bayesian=bayesian).collect()}
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert got["a"].n == 4001 and got["a"]["mean"] == pytest.approx(x.mean())
    assert got["a"].lo == pytest.approx(x.mean() - half, abs=0.1 * half) and got["a"].hi == pytest.approx(x.mean() + half, abs=0.1 * half)
    assert (got["b"].n, got["b"].lo, got["b"].hi) == (1, 0.5, 0.5)
    y = np.arange(1.0, 402.0)
    m = A.resampled(spark.createDataFrame([("c", float(v)) for v in y], "g string, y double"), "y", ["g"], 4000, "median", bayesian).first()
    half = 1.96 * 401 / 2 / math.sqrt(401)  # normal limit of a uniform's median
    assert m.lo == pytest.approx(201 - half, abs=0.15 * half) and m.hi == pytest.approx(201 + half, abs=0.15 * half)
    again = A.resampled(df.repartition(5), "y", ["g"], 4000, bayesian=bayesian).filter("g = 'a'").first()
    assert (again.lo, again.hi) == (got["a"].lo, got["a"].hi)


def test_mixed_logistic_recovers_direction(spark):
    rows = [(q, 1.0, float(x), int((q * 7 + i) % 10 < (8 if x else 3))) for q in range(12) for x in (0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "qid int, one double, x double, y int")
    d = A.mixed_model(df, "y", ["one", "x"], "qid", chains=2, tune=150, draws=150).groupBy("parameter").agg(F.avg("value").alias("m")).collect()
    m = {r.parameter: r.m for r in d}
    assert m["x"] > 1 and m["one"] < 0


def test_keep_or_split_matches_loop(spark):
    text = " ".join(f"Word{i} is here now." for i in range(40))
    out = C.keep_or_split(spark.createDataFrame([(1, text), (2, "short one."), (3, None)], "id int, text string"), "id", "text", most=30).filter("text is not null").orderBy("id", "part").collect()
    chunks, now, n, last = [], "", 0, ""
    for s in text.split(". "):
        s = s if s.endswith(".") else s + "."
        if n and n + 4 > 30:
            chunks.append(now)
            now, n = last, 4
        now, n, last = (f"{now} {s}" if now else s), n + 4, s
    chunks.append(now)
    assert [r.text for r in out if r.id == 1] == chunks
    assert [(r.text, r.sub_section_id) for r in out if r.id == 2] == [("short one.", None)]


def test_pack_segments_matches_loop(spark):
    segs = [(f"w{i} " * (i % 5 + 1), float(i), 1.0) for i in range(30)] + [("  ", 30.0, 1.0)]
    df = spark.createDataFrame([(segs,)], "s array<struct<text:string,start:double,duration:double>>")
    got = [(g.start, g.end) for g in df.select(C.pack_segments(F.col("s"), 10).alias("g")).first().g]
    want, n, start, end = [], 0, None, None
    for t, s, d in segs[:-1]:
        k = len(t.split())
        if start is not None and n + k > 11:
            want.append((start, end))
            start, n = None, 0
        start = s if start is None else start
        n, end = n + k, s + d
    want.append((start, end))
    assert got == want


def test_dispatch_images(spark):
    s = spark.createDataFrame([("f", 1, 3), ("f", 2, 3), ("f", 3, 3), ("f", 4, 9), ("g", 1, 1)], "file string, section_no int, page long")
    p = spark.createDataFrame([("f", 2, ["a"]), ("f", 3, ["b", "c"]), ("f", 5, ["d"])], "file string, image_page long, images array<string>")
    got = {(r.file, r.section_no): (r.image_page, r.images) for r in T.dispatch_images(s, p, "file").collect()}
    assert got == {("f", 1): (3, ["b", "c"]), ("f", 2): (2, ["a"]), ("f", 3): (5, ["d"]), ("f", 4): (None, []), ("g", 1): (None, [])}


def test_text_edges(spark):
    assert one(spark, T.minutes(F.lit(3725.9))) == "62:05" and one(spark, T.minutes(F.lit(None).cast("double"))) is None
    assert one(spark, T.seconds(F.lit("1:02:03"))) == 3723 and one(spark, T.seconds(F.lit("1:2:3:4"))) is None and one(spark, T.seconds(F.lit(""))) is None
    assert one(spark, T.first_line_title(F.lit("  \n "))) is None
    assert one(spark, T.video_id(F.lit("https://www.youtube.com/watch?v=abc&x=1"))) == "abc"
    assert one(spark, T.video_id(F.lit("https://youtu.be/xyz"))) == "xyz"
    assert one(spark, T.ascii_fold(F.lit("é–ﬁ"))) == "efi"
    assert one(spark, T.video_id(F.lit("https://notyoutube.com/watch?v=abc"))) == "watch?v=abc" and one(spark, T.video_id(F.lit("https://youtube.com/watch?t=1"))) is None
    assert [one(spark, T.is_question(F.lit(m + " so?"))) for m in ("🧪", "📚", "⚙️", "💡", "❓", "🔹", "")] == [False] * 5 + [True] * 2
    assert one(spark, F.array_join(M.parse_gold(F.lit("\"a, b,,a'")), "|")) == "a|b"


def test_chunk_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sections": [{"text": "one", "metadata": {"section_title": "T"}}, {"metadata": {}}]}))
    (tmp_path / "b.json").write_text(json.dumps(["plain", json.dumps({"text": "two", "metadata": {"pdf_name": "p.pdf"}})]))
    df = S.read_chunks(spark, str(tmp_path))
    assert {(r.source, r.idx, r.text) for r in df.collect()} == {("a", 0, "one"), ("b", 0, "plain"), ("b", 1, "two")}
    assert S.read_chunks(spark, str(tmp_path), keep_textless=True).count() == 4
    assert {r.title for r in S.with_default_metadata(df).collect()} == {"T", "Unknown section"}


def test_caption_segments(spark):
    j = json.dumps({"events": [{"tStartMs": 1500, "dDurationMs": 500, "segs": [{"utf8": " a"}, {"utf8": "b "}]}, {"tStartMs": 2, "segs": [{"utf8": "\n"}]}, {"tStartMs": 3}]})
    df = spark.createDataFrame([(j,)], "j string").select(S.caption_segments("j").alias("s"))
    assert [tuple(x) for x in df.first().s] == [("ab", 1.5, 0.5)]


def test_retrieve_modes(spark):
    chunks = spark.createDataFrame([(1, "red apple pie", "Apples"), (2, "green apple", "Fruit"), (3, "blue sky", "Sky")], "chunk_id long, text string, title string")
    queries = spark.createDataFrame([(7, "apple pie")], "query_id long, query string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "chunk_id long, v array<double>")
    qv = spark.createDataFrame([(7, [1.0, 0.1])], "query_id long, v array<double>")
    for mode in (*R.MODES, "unknown"):
        got = [r.chunk_id for r in R.retrieve(R.bm25_index(chunks), vec, queries, qv, chunks, mode, k=2).orderBy("rank").collect()]
        assert got[0] == 1 and len(got) <= 2, mode
    assert R.generate(R.prompts(queries, R.context_block(spark.createDataFrame([], "query_id long, rank int, title string, pdf_id string, page_number int, section string, content string")))).first().answer == "apple pie"


def test_ingest_once(spark, tmp_path):
    from heronsift.streaming.ingest import ingest_once

    src, store, cp = (str(tmp_path / x) for x in ("src", "store", "cp"))
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    df.write.parquet(src)
    ingest_once(spark, src, df.schema, store, cp)
    spark.createDataFrame([("b", "y"), ("c", "z")], df.schema).write.mode("append").parquet(src)
    ingest_once(spark, src, df.schema, store, cp)
    assert sorted(r.chunk_id for r in spark.read.parquet(store).collect()) == ["a", "b", "c"]


def test_mixed_model_takes_every_query_and_effect(spark, monkeypatch):
    from heronsift.plans import registry

    rows = spark.createDataFrame([(q, "easy" if q % 2 else "difficult", m, float((q * 7 + i) % 3 > 0)) for q in range(90) for i, m in enumerate(registry.MODES)], "qid long, difficulty string, mode string, success double")
    monkeypatch.setattr(registry, "metric_rows", lambda *_: rows)
    given = {}
    monkeypatch.setattr(A, "mixed_model", lambda df, label, features, group, family, **k: given.update(df=df, features=features, **k) or spark.createDataFrame([(0, 0, "a", 0.0)], "chain long, draw long, parameter string, value double"))
    registry.QUERIES["a21_mixed_model"](spark, "")
    assert given["df"].select("qid").distinct().count() == 90 and given["df"].count() == 360
    assert len(given["features"]) == 8 and (given["chains"], given["tune"], given["draws"]) == (4, 2000, 2000)


def test_mixed_logistic_recovers_spread(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    u = 1.5 * rng.normal(size=300)
    df = spark.createDataFrame([(q, 1.0, float(rng.random() < 1 / (1 + np.exp(-u[q])))) for q in range(300) for _ in range(12)], "qid long, one double, y double")
    d = A.mixed_model(df, "y", ["one"], "qid", chains=2, tune=400, draws=400).groupBy("parameter").agg(F.avg("value").alias("m")).collect()
    m = {r.parameter: r.m for r in d}
    assert abs(np.exp(m["log_sd"]) - u.std()) < 0.35 and abs(m["one"] - u.mean()) < 0.3


@pytest.mark.parametrize("family", ["beta", "zoib"])
def test_beta_models_recover_planted_effects(spark, family):
    import numpy as np

    rng = np.random.default_rng(6)
    u, rows = 0.5 * rng.normal(size=150), []
    for q in range(150):
        for x in (0.0, 1.0):
            for _ in range(4):
                mu = 1 / (1 + np.exp(-(-0.4 + 1.1 * x + u[q])))
                kind = rng.choice(3, p=[0.2, 0.1, 0.7]) if family == "zoib" else 2
                rows.append((q, 1.0, x, [0.0, 1.0, float(np.clip(rng.beta(8 * mu, 8 * (1 - mu)), 1e-4, 1 - 1e-4))][kind]))
    df = spark.createDataFrame(rows, "qid long, one double, x double, y double")
    d = A.mixed_model(df, "y", ["one", "x"], "qid", family, chains=2, tune=400, draws=300)
    m = {r.parameter: r.m for r in d.groupBy("parameter").agg(F.avg("value").alias("m")).collect()}
    assert m["x"] == pytest.approx(1.1, abs=0.15) and m["one"] == pytest.approx(-0.4, abs=0.2) and np.exp(m["log_sd"]) == pytest.approx(0.5, abs=0.15)
    assert np.exp(m["log_phi"]) == pytest.approx(8, rel=0.35)
    if family == "zoib":
        p = A.inflation_of(d).agg(F.avg("p_zero").alias("a"), F.avg("p_one").alias("b"), F.avg("p_middle").alias("c")).first()
        assert (p.a, p.b, p.c) == (pytest.approx(0.2, abs=0.04), pytest.approx(0.1, abs=0.04), pytest.approx(0.7, abs=0.05))


def test_conditions_of_a_fitted_model(spark):
    effects = {"intercept": 0.3, "x_difficulty": -1.0, "x_mode1": 0.5, "x_inter1": 0.25}
    d = spark.createDataFrame([(0, k, n, v) for k in range(3) for n, v in effects.items()], "chain long, draw long, parameter string, value double")
    got = {(r.difficulty, r["mode"]): r.value for r in A.model_conditions(d, ["a", "b"], "easy", "difficult").collect()}
    logistic = lambda z: 1 / (1 + math.exp(-z))
    assert got == {("easy", "a"): pytest.approx(logistic(0.3)), ("easy", "b"): pytest.approx(logistic(0.8)), ("difficult", "a"): pytest.approx(logistic(-0.7)), ("difficult", "b"): pytest.approx(logistic(0.05))}


def test_no_part_passes_the_bound(spark):
    texts = ["word " * 3000, "a-b-c-" * 900, "One. " * 40 + "two " * 700 + "end. Three four.", "short text"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = C.keep_or_split(df, "id", "text", 500).collect()
    assert max(r.token_length for r in got) == 500 and min(r.token_length for r in got) > 0
    for k, t in enumerate(texts[:2]):
        parts = [r.text for r in sorted(got, key=lambda r: r.part) if r.id == k]
        assert "".join("".join(parts).split()) == "".join(t.split()) and len(parts) > 1


def chunk_files(tmp_path):
    items = [
        {"text": "How to split data files by a factor.", "metadata": {"source_type": "pdf", "pdf_name": "Guide.pdf", "section_title": "Splitting", "page_start": "3", "section_id": "S1"}},
        {"text": "Regression needs a dependent variable.", "metadata": {"source_type": "github", "markdown_file": "reg.md", "section_title": "Regression", "md_url": "u"}},
        {"text": "A chapter about plots and figures.", "metadata": {"source_type": "video", "video_title": "Plots", "chapter_title": "Figures", "start_time": "1:05", "url": "w"}},
    ]
    (tmp_path / "manual_a.json").write_text(json.dumps({"sections": items}))
    return str(tmp_path / "manual_a.json")


def test_service_and_command_line(spark, tmp_path, capsys):
    from heronsift import cli, service

    path = chunk_files(tmp_path)
    corpus = service.Corpus.read(spark, path)
    for mode in [*service.modes(), "unknown"]:
        found = service.retrieve(corpus, "  split data by factor ", mode)
        assert found[0]["source_type"] == "pdf" and found[0]["page_number"] == 3 and found[0]["rank"] == 1, mode
    for blank in ("", "  \n", None):
        with pytest.raises(service.EmptyQuery):
            service.retrieve(corpus, blank)
    told = service.answer(corpus, "plots of figures", "m", client=lambda p: "said" if "Figures" in p else "nothing")
    assert set(told) == {"query", "model", "retrieval_mode", "answer", "sources"} and told["answer"] == "said" and told["sources"][0]["rank"] == 1
    assert service.answer(corpus, " ")["sources"] == []  # a failing retrieval leaves none
    assert cli.main(["retrieve", "--chunks", path, "--q", "regression", "--mode", "bm25"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["title"] == "reg.md"
    assert cli.main(["generate", "--chunks", path, "--q", "regression", "--model", "x"]) == 0
    assert json.loads(capsys.readouterr().out)["model"] == "x"
    (tmp_path / "b.json").write_text(json.dumps([{"text": "long text " * 400, "metadata": {"section_id": "L"}}]))
    assert cli.main(["split", "--sections", str(tmp_path / "*.json"), "--pdf", "B", "--out", str(tmp_path / "out")]) == 0
    made = [json.loads(x) for p in (tmp_path / "out").glob("source=*/*.json") for x in p.read_text().splitlines()]
    assert len(made) == 1 and [x["metadata"]["sub_section_id"] for x in made[0]["sections"]] == ["L_part1", "L_part2"]


def test_vector_top_equals_plain_search(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6))
    x[7] = 0
    x[20:40] = x[20]
    rows = [(f"c{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("none", None)]
    df = spark.createDataFrame(rows, "chunk_id string, v array<double>").repartition(4)
    q = df.filter("chunk_id < 'c060'").withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(R, "QUERY_BYTES", 6 * 8 * 11)
    monkeypatch.setattr(R, "VECTOR_BYTES", 4000)
    got = {}
    for r in R.vector_top(df, q, 5, digits=9).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.chunk_id
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    assert set(got) == {f"c{i:03d}" for i in range(60) if i != 7}
    for name, ranks in got.items():
        s = np.round(u @ u[int(name[1:])], 9)
        s[7] = -np.inf
        assert [ranks[k] for k in range(1, 6)] == [f"c{i:03d}" for i in np.lexsort((np.arange(300), -s))[:5]]
    assert R.vector_top(df, q.limit(0)).count() == 0


def test_index_can_be_stored(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma"), (3, "")], "chunk_id long, text string")
    asked = spark.createDataFrame([(0, "gamma beta")], "query_id long, query string")
    index = R.bm25_index(chunks)
    R.store_index(index, str(tmp_path / "index"))
    assert R.bm25(R.load_index(spark, str(tmp_path / "index")), asked).collect() == R.bm25(index, asked).collect()


def test_sinks_and_sources(spark, tmp_path):
    text = lambda folder, ending: "".join(p.read_text() for p in sorted((tmp_path / folder).glob(f"*.{ending}")))
    (tmp_path / "d.json").write_text(json.dumps([{"name": "a.pdf", "source_url": "u", "local_path": "p", "success": True, "filesize_bytes": 7, "timestamp": "t"}]))
    assert S.read_downloads(spark, str(tmp_path / "d.json")).first().filesize_bytes == 7
    (tmp_path / "g.json").write_text(json.dumps({"github": [{"repo": "a/b"}, {"repo": "c/d", "folder": "docs"}]}))
    assert [r.folder for r in S.read_repositories(spark, str(tmp_path / "g.json")).orderBy("repo").collect()] == ["inst/help", "docs"]
    (tmp_path / "v.json").write_text(json.dumps({"videos": [{"name": "n", "url": "u", "category": "c", "language": "en"}]}))
    assert S.read_videos(spark, str(tmp_path / "v.json")).first().name == "n"
    S.write_markdown(spark.createDataFrame([("x", "# A\ntext")], "file string, markdown string"), str(tmp_path / "md"))
    assert text("md/file=x", "txt") == "# A\ntext\n"
    sections = spark.sql("select 's' source, 't' text, named_struct('a', 'b', 'n', cast(null as string)) metadata")
    S.write_section_list(sections, str(tmp_path / "list"))
    assert json.loads(text("list/source=s", "json")) == {"text": "t", "metadata": {"a": "b"}}
    S.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "csv"))
    assert set(text("csv", "csv").split()) == {"a,b", "1,x"}
    S.write_jsonl(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "jl"))
    assert json.loads(text("jl", "json")) == {"a": 1}
    (tmp_path / "j.csv").write_text("QID,Question,Difficulty Level,Retrieval Mode,Rank,Retrieved Doc,Relevance,Gold Standard Set\n1,q,easy, BM25 ,x,d,2,'a,b'\n".replace("'", '"'))
    assert S.read_judgements(spark, str(tmp_path / "j.csv")).first().gold == "a,b"
    (tmp_path / "t.json").write_text(json.dumps([{"id": "q_1", "query": "w?", "relevant_chunk_ids": ["a"]}]))
    assert S.read_tests(spark, str(tmp_path / "t.json")).first().relevant_chunk_ids == ["a"]
    (tmp_path / "q.txt").write_text("🧪 skip?\n\nwhat is it?\nno question\n")
    assert [r.query for r in S.read_questions(spark, str(tmp_path / "q.txt")).collect()] == ["what is it?"]
    assert M.missing_columns(sections, ["text", "qid", "k"]) == ["k", "qid"]


def test_captions_are_made_once(spark, tmp_path):
    images = spark.createDataFrame([("f", 1, ["a.png", None]), ("f", 2, ["bad.png"])], "file string, page int, images array<string>")

    def caption(path):
        if path == "bad.png":
            raise OSError(path)
        return "seen " + path

    store = str(tmp_path / "captions")
    first = {r.page: r.summaries for r in S.cached_captions(spark, images.filter("page = 1"), store, lambda df: R.captions(df, caption)).collect()}
    both = {r.page: r.summaries for r in S.cached_captions(spark, images, store, lambda df: R.captions(df, lambda p: "again" if p == "a.png" else caption(p))).collect()}
    assert first == {1: ["seen a.png", ""]} and both == {1: ["seen a.png", ""], 2: ["(no summary)"]}


def test_video_chunks(spark):
    text = "one two three. " * 60
    rows = [("v1", "desc here", [(0.0, "Intro", 5.0, text), (5.0, "Void", 6.0, " ")], []), ("v2", None, [(0.0, None, 9.0, "x")], [("a b", 0.0, 1.0), ("c d", 1.0, 1.0)]), ("v3", "", None, [("e", 0.0, 1.0)])]
    df = spark.createDataFrame(rows, "video_id string, description string, chapters array<struct<start_time:double,title:string,end_time:double,text:string>>, segments array<struct<text:string,start:double,duration:double>>")
    got = {(r.video_id, r.section_id): r.source for r in C.video_chunks(df, 100).collect()}
    assert got == {("v1", "v1_desc_0"): "description", ("v1", "v1_ch1_part0"): "chapter", ("v1", "v1_ch1_part1"): "chapter", ("v2", "v2_seg0"): "transcript_fallback", ("v3", "v3_seg0"): "transcript_fallback"}


def test_markdown_chunks(spark):
    df = spark.createDataFrame([(1, "# A\nfirst\n\n## B\n" + "word. " * 700 + "\n\n   \n# C\n")], "id long, text string")
    got = C.markdown_chunks(df, "id", "text", 500).orderBy("node", "part").collect()
    assert [r.section_title for r in got][0] == "# A" and max(r.token_length for r in got) <= 500 and len(got) == 4


def test_corpus_builds(spark, tmp_path):
    from heronsift.plans import corpus

    pages = [("m", 5, "Preface text"), ("m", 6, "USING THE TOOL\nFirst words\n12 | P a g e\nR² = 3\n\nthen\nSECOND PART\nMORE TITLE\nOther\nTOOL 0.1 banned"), ("m", 7, "THIRD PART\nLast")]
    df = spark.createDataFrame(pages, "file string, page int, text string")
    d = corpus.pdf_documents(df, ("TOOL 0.",), "USING THE TOOL (page 6)")
    got = d.orderBy("n").collect()
    assert [(r.section_title, r.section_id) for r in got] == [("USING THE TOOL", "USING_THE_TOOL_PAGE_6"), ("SECOND PART: MORE TITLE", "SECOND_PART_MORE_TITLE_PAGE_6"), ("THIRD PART", "THIRD_PART_PAGE_7")]
    assert "$$R^2" in got[0].text and "P a g e" not in got[0].text and "banned" not in got[1].text
    assert got[2].image_placeholders == ["[IMAGE_PLACEHOLDER_THIRD_PART_PAGE_7]"] and all(r.token_length > 0 and r.pdf_name == "m.pdf" for r in got)
    images = spark.createDataFrame([("m", 6, ["a", "b"]), ("m", 8, ["c"])], "file string, page int, images array<string>")
    sources = spark.createDataFrame([("m", "u2", "s"), ("m", "u1", "s")], "name string, source_url string, source_name string")
    full = corpus.with_images(d, images, sources, lambda p: "seen " + p).orderBy("n").collect()
    assert [r.image_summaries for r in full] == [["seen a", "seen b"], ["seen c"], []] and {r.source_url for r in full} == {"u1"}
    assert full[0].text.endswith("Associated image descriptions:\nseen a\nseen b") and full[0].token_length > got[0].token_length

    shape = "video_id string, description string, duration double, chapters array<struct<start_time:double,title:string,end_time:double>>, segments array<struct<text:string,start:double,duration:double>>"
    heard = [("one", 0.0, 4.0), ("two", 5.0, 4.0), ("three", 10.0, 2.0)]
    v = spark.createDataFrame([("a", "d", None, [(0.0, "x", None), (6.0, "y", None)], heard), ("b", None, 20.0, [], heard)], shape)
    made = {r.section_id: r.text for r in corpus.video_documents(v).collect()}
    assert made == {"a_desc_0": "d", "a_ch1_part0": "one two", "a_ch2_part0": "two three", "b_seg0": "one two three"}
    store = str(tmp_path / "videos")
    corpus.write_new_videos(spark, v.select("video_id", "description"), store)
    corpus.write_new_videos(spark, v.select("video_id", "description").unionByName(spark.createDataFrame([("c", "n")], "video_id string, description string")), store)
    assert sorted(r.video_id for r in spark.read.json(store).collect()) == ["a", "b", "c"]
    assert one(spark, T.embed_url(F.lit("https://y/watch?v=1"), F.lit(7))) == "https://y/embed/1?start=7"


def test_run_with_a_function_and_a_chain_of_scorers(spark):
    tests = spark.createDataFrame([("a", "one", ["x"]), ("b", " ", ["y"]), ("c", "two", ["z"])], "id string, query string, relevant_chunk_ids array<string>")
    asked = []

    def found(queries, k):
        asked.extend(r.id for r in queries.collect())
        return spark.createDataFrame([("a", 1, None, "x"), ("c", 1, "q", None), ("c", 4, "z", None)], "id string, rank int, doc_id string, section_id string")

    got = {r.id: (r.success_at_k, r.top1_relevant) for r in M.run_with(found, tests).collect()}
    assert sorted(asked) == ["a", "c"] and got == {"a": (True, True), "c": (False, False)}

    def absent(*_):
        raise ImportError("no model")

    hits = spark.createDataFrame([(0, 1, 0.5, 1), (0, 2, 0.4, 2)], "query_id long, chunk_id long, score double, rank int")
    chunks = spark.createDataFrame([(1, "pear"), (2, "apple")], "chunk_id long, text string")
    queries = spark.createDataFrame([(0, "apple")], "query_id long, query string")
    assert [r.chunk_id for r in R.rerank_chain(absent, R.coverage_rerank)(hits, queries, chunks, 1).collect()] == [2]
    assert [r.chunk_id for r in R.rerank_chain(absent)(hits, queries, chunks, 1).collect()] == [1]
