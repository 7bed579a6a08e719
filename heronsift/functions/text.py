"""Text, identifier, URL and interval functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def clean_page(text: Column, banned: tuple[str, ...] = (), footer: str = r"^\d+\s*\|\s*P\s*a\s*g\s*e") -> Column:
    """Drop footer lines and lines that hold a banned string; strip."""

    def keep(line: Column) -> Column:
        ok = ~line.rlike(footer)
        for b in banned:
            ok = ok & ~line.contains(b)
        return ok

    return strip(F.array_join(F.filter(_lines(text), keep), "\n"))


def is_upper_title(line: Column) -> Column:
    """All capitals, two words or more."""
    return (F.upper(line) == line) & (F.lower(line) != line) & (F.size(F.split(strip(line), r"\s+")) >= 2)


def merge_upper_titles(text: Column) -> Column:
    """Join runs of title lines by ``": "``."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("open"))

    def step(a: Column, line: Column) -> Column:
        t, n = is_upper_title(line), F.size(a["done"])
        joined = F.concat(F.slice(a["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(a["done"], F.lit(-1)), F.lit(": "), line)))
        return F.struct(F.when(t & a["open"], joined).otherwise(F.concat(a["done"], F.array(line))).alias("done"), t.alias("open"))

    return F.aggregate(_lines(text), empty, step, lambda a: F.array_join(a["done"], "\n"))


def is_header(line: Column) -> Column:
    """A section header: a title line without any of ``= _ < >``."""
    return is_upper_title(line) & ~line.rlike("[=_<>]")


def sections(pages: DataFrame, id_col: str, text_col: str, page: Column) -> DataFrame:
    """Split at header lines: one row per section, title with its page, null for a leading part.

    Lines are stripped, blank ones dropped and runs of titles merged first.
    """
    full = F.filter(F.transform(_lines(F.col(text_col)), strip), lambda x: x != "")
    merged = F.when(F.size(full) > 0, _lines(merge_upper_titles(F.array_join(full, "\n"))))
    lines = pages.select(id_col, page.alias("page"), F.posexplode(merged).alias("line_no", "line"))
    w = Window.partitionBy(id_col).orderBy("line_no")
    head = is_header(F.col("line"))
    numbered = lines.withColumn("head", head).withColumn("section_no", F.sum(head.cast("int")).over(w))
    body = F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line"))))
    title = F.max(F.when(F.col("head"), F.concat("line", F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))))
    return numbered.groupBy(id_col, "section_no").agg(title.alias("title"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("content"))


@F.pandas_udf(StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII."""
    fold = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    return text.map(lambda t: None if t is None else fold(t))


#: What a line that begins with an equation becomes, whatever follows.
EQUATIONS = (
    (r"(?i)^R\s*\^?\s*2\s*=", r"$$R^2 = \frac{SS_M}{SS_T}$$"),
    (r"(?i)^F\s*=", r"$$F = \frac{Mean\ SS_M}{Mean\ SS_R}$$"),
    (r"(?i)^t\s*=", r"$$t = \frac{\text{mean group 1 - mean group 2}}{\text{standard error of mean differences}}$$"),
)


def rewrite_equations(text: Column) -> Column:
    """Fold to ASCII, strip lines, drop blank ones; a line that begins with R^2=, F= or t= becomes a fixed formula."""

    def form(line: Column) -> Column:
        out = line
        for pattern, formula in reversed(EQUATIONS):
            out = F.when(line.rlike(pattern), F.lit(formula)).otherwise(out)
        return out

    lines = F.filter(F.transform(_lines(ascii_fold(text)), strip), lambda x: x != "")
    return F.array_join(F.transform(lines, form), "\n")


def drop_numeric_tables(text: Column) -> Column:
    """Drop blank blocks, and blocks of over six lines that are mostly numbers and repeat themselves."""

    def keep(block: Column) -> Column:
        lines = F.filter(F.transform(_lines(block), strip), lambda x: x != "")
        n = F.size(lines)
        numeric = F.size(F.filter(lines, lambda x: x.rlike(r"^[\d\s.,%]+$"))) / n
        repeated = 1 - F.size(F.array_distinct(lines)) / n
        return F.when(n > 0, ~((n > 6) & (numeric > 0.6) & (repeated > 0.3))).otherwise(False)

    return F.array_join(F.filter(F.split(text, "\n\n"), keep), "\n\n")


def slug(text: Column) -> Column:
    """Upper case, other characters than letters and digits to single ``_``, none at the ends."""
    return F.upper(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def placeholder(tag: Column) -> Column:
    return F.concat(F.lit("[IMAGE_PLACEHOLDER_"), tag, F.lit("]"))


def placeholders(text: Column) -> Column:
    """All image placeholders, upper-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[image_placeholder_[a-z0-9_]+\]"), F.lit(0)), F.upper)


def section_id(title: Column, page: Column) -> Column:
    return F.concat(slug(title), F.lit("_PAGE_"), page.cast("string"))


def markdown(titles_and_texts: Column) -> Column:
    """Join ``struct<title, content>`` items as headed blocks."""
    return F.array_join(F.transform(titles_and_texts, lambda s: F.concat(F.lit("# "), s["title"], F.lit("\n"), s["content"])), "\n\n")


def markdown_with_images(titles_and_texts: Column) -> Column:
    """As ``markdown``, each block followed by its image heading and placeholder."""
    block = lambda s: F.concat(F.lit("# "), s["title"], F.lit("\n"), s["content"], F.lit("\n\n# "), s["title"], F.lit("-IMAGE DESCRIPTIONS\n"), placeholder(slug(s["title"])))
    return F.array_join(F.transform(titles_and_texts, block), "\n\n")


def from_marker(text: Column, marker: str) -> Column:
    """The text from a marker on, or all of it."""
    return F.when(F.instr(text, marker) > 0, F.substr(text, F.instr(text, marker))).otherwise(text)


def markdown_sections(text: Column) -> Column:
    """``struct<title, page, text>`` for each ``# title (page n)`` heading."""
    parts = F.filter(F.split(text, r"(?m)^(?=# .+? \(page \d+\))"), lambda p: p.rlike(r"^# .+? \(page \d+\)"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^# (.+?) \(page (\d+)\)", 1).alias("title"), F.regexp_extract(p, r"^# (.+?) \(page (\d+)\)", 2).cast("int").alias("page"), strip(F.regexp_replace(p, r"^# .+? \(page \d+\)", "")).alias("text")))


def token_count(text: Column, specials: int = 0) -> Column:
    """Deterministic stand-in for a model's tokenizer: runs of letters and digits."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")), F.lit(0)) + specials


def drop_empty(m: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


#: Hosts of long and of short video links.
LONG_HOSTS, SHORT_HOST = ("www.youtube.com", "youtube.com"), "youtu.be"


def video_id(url: Column) -> Column:
    """The ``v`` parameter of a long link (null without one), the path of a short link, else what follows the last slash."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    v = F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")), F.lit(""))
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+", "")
    return F.when(host.isin(*LONG_HOSTS), F.try_url_decode(v)).when(host == SHORT_HOST, path).otherwise(F.element_at(F.split(url, "/"), -1))


def file_name(name: Column) -> Column:
    """Word characters, spaces as ``_`` and hyphens, 80 at most."""
    return F.left(F.regexp_replace(strip(F.regexp_replace(name, r"[^\w\s-]", "")), r"\s+", "_"), F.lit(80))


def minutes(seconds: Column) -> Column:
    """Seconds as ``m:ss``; minutes may pass 59."""
    s = F.floor(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def seconds(stamp: Column) -> Column:
    """``h:m:s``, ``m:s`` or ``s`` as seconds; anything else null."""
    p = F.transform(F.split(stamp, ":"), lambda x: x.try_cast("double"))
    n = F.size(p)
    at = lambda k: F.try_element_at(p, F.lit(k))
    return F.when(strip(stamp) == "", None).when(n == 3, at(1) * 3600 + at(2) * 60 + at(3)).when(n == 2, at(1) * 60 + at(2)).when(n == 1, at(1))


def first_line_title(text: Column, most: int = 120, words: int = 15) -> Column:
    """The first line; of long ones the first words and an ellipsis; blank: null."""
    line = strip(F.element_at(_lines(strip(text)), 1))
    short = F.concat(F.array_join(F.slice(F.split(line, r"\s+"), 1, words), " "), F.lit("..."))
    return F.when(line == "", None).when(F.char_length(line) > most, short).otherwise(line)


def repo_prefix(name: Column) -> Column:
    """What stands before the first ``__``, null without one."""
    return F.when(name.contains("__"), F.element_at(F.split(name, "__", 2), 1))


def repo_lookup(files: DataFrame, repos: DataFrame, name: str) -> DataFrame:
    """Files whose prefix is a known ``repo`` (owner/name), with its columns; others are skipped.

    A list of repositories is small, but the side to broadcast is left to the optimizer.
    """
    known = repos.withColumn("hs_prefix", F.replace("repo", F.lit("/"), F.lit("_")))
    return files.withColumn("hs_prefix", repo_prefix(F.col(name))).join(known, "hs_prefix").drop("hs_prefix")


def source_lookup(df: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    """Each row with the first source (by url) of its name; nulls where there is none."""
    first = sources.groupBy(name).agg(F.min_by(F.struct(*(c for c in sources.columns if c != name)), "source_url").alias("x")).select(name, "x.*")
    return df.join(first, name, "left")


def nearest_page(sections_: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """As-of lookup: the exact or last earlier page, else the first later one."""
    j = sections_.join(pages, by, "left")
    back = F.max(F.when(F.col("image_page") <= F.col("page"), F.col("image_page")))
    ahead = F.min(F.when(F.col("image_page") > F.col("page"), F.col("image_page")))
    return j.groupBy(by, "section_id", "page").agg(F.coalesce(back, ahead).alias("nearest"))


def dispatch_images(sections_: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """Each section in order takes all images of its page, or of the nearest page that has any left."""

    def take(key, s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        left = {int(r.image_page): list(r.images) for r in p.itertuples()}
        rows = []
        for r in s.sort_values("section_no").itertuples():
            some = [x for x in left if left[x]]
            back, ahead = [x for x in some if x <= r.page], [x for x in some if x > r.page]
            page = max(back) if back else min(ahead) if ahead else None
            rows.append((key[0], r.section_no, page, left.pop(page) if page is not None else []))
        return pd.DataFrame(rows, columns=[by, "section_no", "image_page", "images"]).astype({"image_page": "Int64"})

    kind = dict(sections_.dtypes)[by]
    return sections_.groupBy(by).cogroup(pages.groupBy(by)).applyInPandas(take, f"{by} {kind}, section_no int, image_page long, images array<string>")


def with_descriptions(text: Column, summaries: Column) -> Column:
    return F.when(F.size(summaries) > 0, F.concat(text, F.lit("\n\nAssociated image descriptions:\n"), F.array_join(summaries, "\n"))).otherwise(text)


def flat_metadata(m: Column) -> Column:
    """A map of JSON values as plain strings; nulls go, lists are joined by a comma."""
    listed = lambda v: F.array_join(F.from_json(v, "array<string>"), ", ")
    return F.map_filter(F.transform_values(m, lambda k, v: F.when(v.startswith("["), listed(v)).otherwise(v)), lambda k, v: v.isNotNull())


def or_else(*cs: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def chunk_id(source: Column, idx: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("_", source, idx.cast("string"), text))


def node_key(doc_id: Column, source: Column, text: Column, file: Column | None = None) -> Column:
    """What fusion and de-duplication compare: the first set name and the stripped text."""
    names = [doc_id, source] + ([] if file is None else [file])
    return F.md5(F.concat(F.coalesce(or_else(*names), F.lit("")), F.lit("::"), strip(text)))


#: Line starts that mark headings, not questions.
HEADING_MARKS = ("🧪", "📚", "⚙️", "💡", "❓")


def is_question(line: Column, skipped: tuple[str, ...] = HEADING_MARKS) -> Column:
    """A line that ends in a question mark and does not begin with a heading's mark."""
    told = strip(line)
    ok = told.endswith("?")
    for mark in skipped:
        ok = ok & ~told.startswith(mark)
    return ok


def raw_url(url: Column) -> Column:
    """A repository page as its raw file."""
    return F.replace(F.replace(F.replace(url, F.lit("/tree/"), F.lit("/blob/")), F.lit("https://github.com/"), F.lit("https://raw.githubusercontent.com/")), F.lit("/blob/"), F.lit("/"))


def embed_url(url: Column, start: Column) -> Column:
    return F.concat(F.replace(url, F.lit("watch?v="), F.lit("embed/")), F.lit("?start="), start.cast("string"))


def page_url(url: Column, page: Column) -> Column:
    return F.concat(url, F.lit("#page="), page.cast("string"))
