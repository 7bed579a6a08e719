"""Mixing, exact dedup and URL rules against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import re

import pytest

from heronsift.llm import exact_dedup, mixing, url_rules
from heronsift.llm.common import new_path

#: Columns whose names the operators use inside as well.
SCHEMA = "doc_id long, text string, source string, size long, kept boolean, hs_rank int, digest string"
ROWS = [
    (1, "a b  c", "x"), (2, "a bc", "x"), (3, None, "x"), (4, "", None), (5, " \t\n", "y"), (6, "abc", None), (7, "é\u00a0 z", "y"),
    (8, "long " * 30_000, "z"), (9, "long " * 30_000 + "\n", "z"), (None, "abc", "y"), (None, None, None), (1, "a b  c", "x"), (10, "w " * 40, "x"), (11, "v " * 7, "y"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 5, True, 1, "d") for r in rows], SCHEMA)


def groups(rows):
    by = {}
    for k, (i, t, _) in enumerate(rows):
        by.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k, i))
    return by


@pytest.mark.parametrize("bits", [256, 8, 4])
def test_exact_duplicates(spark, bits):
    got = exact_dedup.exact_duplicates(docs(spark), digest_bits=bits).collect()
    by = groups(ROWS)
    assert len(got) == len(ROWS)
    want = []
    for plain, members in by.items():
        keep = min(members)
        for m in members:
            want.append((m[4], keep[4], len(members), hashlib.sha256(plain.encode()).hexdigest()))
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=order) == sorted(want, key=order)
    assert sum(r.kept for r in got) == len(by)


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs(spark, [])).columns == docs(spark, []).columns


def test_drop_exact_duplicates_keeps_columns(spark):
    kept = exact_dedup.drop_exact_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == len(groups(ROWS))


def test_state_goes_on_between_runs(spark):
    table, state = new_path(spark, "arr"), new_path(spark, "state")
    first = exact_dedup.arrivals(docs(spark, ROWS[:6]))
    first.write.parquet(table)
    exact_dedup.absorb(spark, table, first.schema, state).count()
    exact_dedup.arrivals(docs(spark, ROWS[6:])).write.mode("append").parquet(table)
    got = exact_dedup.absorb(spark, table, first.schema, state).collect()
    assert sorted(r.group_size for r in got) == sorted(len(m) for m in groups(ROWS).values())


def targets(words, weights=(5, 2, 1)):
    names = sorted(words, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    capped, total = set(), sum(words.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * words[s] for s in capped)
        share = {s: w[s] * rest / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * words[s]}
        if not over:
            return {s: 3.0 * words[s] if s in capped else share[s] for s in names}
        capped |= over


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_mix(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(i, "w " * (i % 13 * (50 if i % 97 == 0 else 1)), f"s{'0' if i % 3 == 0 else i % 7}") for i in range(600)] + [(1000 + i, "u v w", None) for i in range(5)] + [(2000, None, "s1"), (2001, "  ", "void")]
    got = mixing.mix_sizes(docs(spark, rows)).collect()
    words = {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + len((t or "").split())
    want = targets(words)
    taken = {}
    for r in got:
        assert r.source_size == words[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0) <= (r.taken == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(len((x or "").split()) for _, x, y in rows if y == s), s
    again = mixing.mix_sizes(docs(spark, rows[::-1]).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_awkward_rows(spark):
    assert mixing.mix_sizes(docs(spark)).count() == len(ROWS)
    assert mixing.mix_sizes(docs(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix_sizes(docs(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}
    out = mixing.mix(docs(spark))
    assert out.columns == docs(spark).columns
    sizes = {r["size"] for r in out.select("size").collect()}
    assert sizes == {5}  # the input's own column of that name


def test_rows_alike_draw_for_themselves(spark):
    # 200 equal rows without id, and 200 of one id, must still come near their targets.
    rows = [(None, "a b c d", "a")] * 200 + [(7, "e f g", "b")] * 200 + [(100 + i, "w " * 9, "c") for i in range(200)]
    got = mixing.mix_sizes(docs(spark, rows)).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert len(mine) == 200 and abs(sum(r.taken for r in mine) - mine[0].target) <= 9, s
        assert all(r.taken <= 3 * r["size"] for r in mine)
    out = mixing.mix(docs(spark, rows)).groupBy("source").count().collect()
    assert {r.source: r["count"] * {"a": 4, "b": 3, "c": 9}[r.source] for r in out} == {s: sum(r.taken for r in got if r.source == s) for s in "abc"}


def test_larger_classes_are_likelier(spark):
    rows = [(i, "w " * 3, "a") for i in range(400)] + [(i, "w " * 40, "a") for i in range(400, 800)] + [(9000 + i, "w " * 100, "b") for i in range(400)]
    got = mixing.mix_sizes(docs(spark, rows), weights=(1, 4)).filter("source = 'a'").collect()
    share = lambda n: sum(r.taken > 0 for r in got if r["size"] == n) / 400
    assert share(40) > share(3) > 0


URLS = [
    "http://example.com/en/1", "https://a.example.com/en/77", "https://EXAMPLE.com/en/7?x", "http://example.net/de/81", "http://x.net/de/8", "ftp://sub.example.net/de/8#y",
    "http://badexample.net/de/8", "http://foo.org/es/", "http://foo.org/es", "http://org/es/1", "no url", None, "", "http://", "x://host?/en/", "http://a.com/EN/1",
    "http://ads.site.io/", "http://site.io/casino/x", "http://site.io/casinos", "http://site.io/porn/research/1", "http://example.org/es/\n1", "a://b://com/en/", "http://com.evil.io/en/",
]


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    hits = [r for r in url_rules.PATTERNS if re.search(r.pattern, host + path)]
    return host, path, None, "block" if hits and all(r.verdict == "block" for r in hits) else "allow"


@pytest.mark.parametrize("tokens,rules", [(64, 100_000), (0, 100_000), (0, 0)])
def test_urls(spark, monkeypatch, tokens, rules):
    monkeypatch.setattr(url_rules, "MAP_TOKENS", tokens)
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", rules)
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)] + [(0, URLS[0], "x", "y"), (None, URLS[0], "x", "y")], "page_id long, url string, host string, token string")
    got = url_rules.judge_urls(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(URLS[r.page_id or 0])
    assert url_rules.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, ()).collect()} == {"allow"}


def test_many_literals(spark):
    rules = tuple(url_rules.pattern_rule("block", f"/w{k}x", f"w{k}x") for k in range(1500))
    pages = spark.createDataFrame([(k, f"http://a.com/w{k}x") for k in range(0, 1600, 100)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {k: "block" if k < 1500 else "allow" for k in range(0, 1600, 100)}


def test_rule_without_path(spark):
    rule = url_rules.host_path_rule("block", "net", "")
    pages = spark.createDataFrame([(1, "http://a.net"), (2, "http://net/x"), (3, "http://netflix.com/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, (rule,)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_rules_from_a_list(spark, tmp_path):
    (tmp_path / "rules.json").write_text("""{"verdict": "block", "host": "Bad.com", "path": "/x"}\n{"verdict": "block", "pattern": "/spam[0-9]+", "tokens": []}\n""")
    rules = url_rules.read_rules(spark, str(tmp_path))
    urls = ["http://a.bad.com/xy", "http://bad.com/y", "http://ok.com/spam7", "http://ok.com/spam"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.verdict for r in url_rules.judge_urls(pages, rules).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]
    (tmp_path / "rules.json").write_text('{"verdict": "perhaps", "host": "a"}')
    with pytest.raises(ValueError):
        url_rules.read_rules(spark, str(tmp_path))
