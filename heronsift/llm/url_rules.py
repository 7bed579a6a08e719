"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that any match must hold
whole.  Token counts over all URLs choose each rule's rarest token; a URL's
tokens fetch the rules filed under them, and only those rules' expressions run.
Rules without a whole literal token are tried on every URL.

Two kinds of rules share the index: host-and-path rules, of which the longest
that fits decides alone, and free pattern rules, which decide where no
host-and-path rule fits (block if any blocking pattern fits and no allowing
pattern does; else allow).

Defined cases: a null URL or one without ``://`` has empty host and path, fits
no host-and-path rule and is allowed unless a pattern fits its text; repeated
rows and null ids are judged row by row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of up to this number of tokens are a map in the plan, so no row is shuffled.
MAP_TOKENS = 64
#: Rules of more tokens are joined; up to this number of rules by a broadcast.
BROADCAST_RULES = 100_000


#: After a host without a path.
END = r"(?:/|\z)"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against ``host + path``; ``tokens`` stand whole in every match."""

    verdict: str  # allow or block
    pattern: str
    tokens: tuple[str, ...]
    name: str
    exact: bool  # a host-and-path rule


def host_path_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``.

    The path's last token may go on in a URL, so only closed tokens are indexed.
    """
    closed = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower()) if re.fullmatch(r"[\x00-\x7f]*", path) else []
    quote = lambda s: re.sub(r"([^A-Za-z0-9/_])", r"\\\1", s)
    return Rule(verdict, rf"^(?:[^/]*\.)?{quote(host)}{quote(path) or END}", (*re.findall("[a-z0-9]+", host), *closed), host + path, True)


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    return Rule(verdict, pattern, tokens, pattern, False)


#: The contract's rules.
LISTED = (
    host_path_rule("block", "com", "/en/"),
    host_path_rule("allow", "example.com", "/en/7"),
    host_path_rule("allow", "net", "/de/"),
    host_path_rule("block", "example.net", "/de/8"),
    host_path_rule("block", "org", "/es/"),
)

#: Patterns of advertising, gambling, adult and session pages.
PATTERNS = (
    pattern_rule("block", r"(?:^|[.\-])(?:ad|ads|adserver)[0-9]*\.", ),
    pattern_rule("block", r"(?:^|[^a-z0-9])casino(?:[^a-z0-9]|$)", "casino"),
    pattern_rule("block", r"(?:^|[^a-z0-9])porn(?:[^a-z0-9]|$)", "porn"),
    pattern_rule("block", r"(?:^|[^a-z0-9])xxx(?:[^a-z0-9]|$)", "xxx"),
    pattern_rule("block", r"/cgi-bin/", "cgi", "bin"),
    pattern_rule("block", r"/wp-login\.php$", "wp", "login", "php"),
    pattern_rule("block", r"/(?:user/)?(?:login|signup)/?$"),
    pattern_rule("allow", r"/porn/(?:addiction|research)/", "porn"),
)


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Rules from JSON lines: ``verdict`` with ``host`` and ``path``, or with ``pattern`` and ``tokens``; a rule list is small."""
    shape = "verdict string, host string, path string, pattern string, tokens array<string>"
    made = []
    for r in spark.read.schema(shape).json(path).orderBy("host", "path", "pattern", "verdict").collect():
        if r.verdict not in ("allow", "block") or (r.host is None) == (r.pattern is None):
            raise ValueError(f"not a rule: {r}")
        made.append(host_path_rule(r.verdict, r.host.lower(), r.path or "") if r.host is not None else pattern_rule(r.verdict, r.pattern, *(r.tokens or [])))
    return tuple(made)


def split_url(url: Column | str) -> tuple[Column, Column]:
    """``host`` (A-Z lower-cased) and ``path`` columns of a URL."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(u, shape, 1), _UPPER, _LOWER), F.regexp_extract(u, shape, 2)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, pattern``."""
    spark = pages.sparkSession
    host, path = split_url(url_col)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(target, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0)))

    # The rarest token of each rule, by the number of URLs that hold it.
    literal = sorted({t for r in rules for t in r.tokens})
    seen: dict[str, int] = {}
    if literal:
        wanted = F.array(*(F.lit(t) for t in literal)) if len(literal) <= 1000 else None
        held = urls.select(F.explode(F.array_intersect(tokens, wanted) if wanted is not None else tokens).alias("token"))
        if wanted is None:
            held = held.join(spark.createDataFrame([(t,) for t in literal], "token string"), "token", "left_semi")
        seen = {r.token: r.n for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per rule token at most

    # Ordinals: listed rules above patterns, longer above shorter, so the largest decides.
    order = sorted(rules, key=lambda r: (r.exact, len(r.name) if r.exact else r.verdict == "allow", r.name))
    rows = [(k, min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else "", r.pattern) for k, r in enumerate(order)]
    probes = F.concat(F.array(F.lit("")), tokens)
    filed: dict[str, list] = {}
    for k, token, pattern in rows:
        filed.setdefault(token, []).append(F.struct(F.lit(k).alias("ordinal"), F.lit(pattern).alias("pattern")))
    if rows and len(filed) <= MAP_TOKENS:
        index = F.create_map(*(x for token, some in filed.items() for x in (F.lit(token), F.array(*some))))
        fetched = F.flatten(F.filter(F.transform(probes, lambda t: F.try_element_at(index, t)), lambda some: some.isNotNull()))
        fits = F.expr("array_max(transform(filter(fetched, c -> concat(host, path) rlike c.pattern), c -> c.ordinal))")
        best = urls.withColumn("fetched", fetched).withColumn("ordinal", fits).drop("fetched")
    else:
        index = spark.createDataFrame(rows, "ordinal int, token string, pattern string")
        index = F.broadcast(index) if len(rows) <= BROADCAST_RULES else index
        row = "hs_row"
        fetched = urls.withColumn(row, F.monotonically_increasing_id()).withColumn("token", F.explode(probes)).join(index, "token", "left")
        fits = F.when(F.col("pattern").isNotNull() & F.expr("concat(host, path) rlike pattern"), F.col("ordinal"))
        best = fetched.groupBy(row, "page_id", "host", "path").agg(F.max(fits).alias("ordinal"))
    if not rows:
        return best.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    said = spark.createDataFrame([(k, r.name if r.exact else None, r.verdict, None if r.exact else r.name) for k, r in enumerate(order)], "ordinal int, rule string, verdict string, pattern string")
    said = F.broadcast(said) if len(rows) <= BROADCAST_RULES else said
    return best.join(said, "ordinal", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "pattern")
