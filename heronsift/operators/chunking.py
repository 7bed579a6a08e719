"""Cutting texts into token-bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronsift.functions.text import first_line_title, strip, token_count

MAX_TOKENS, OVERLAP = 500, 50


def header_nodes(text: Column) -> Column:
    """One part per ``#`` heading, which stays in it; blank parts go."""
    return F.filter(F.split(text, r"(?m)^(?=#{1,6}\s)"), lambda p: strip(p) != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: strip(s) != "")


def bounded_pieces(text: Column, most: int) -> Column:
    """Sentences; one of more than ``most`` tokens in greedy runs of words, and a word of more in runs of tokens."""
    runs = lambda w: F.regexp_extract_all(w, F.lit(f"[^A-Za-z0-9]*(?:[A-Za-z0-9]+[^A-Za-z0-9]*){{1,{most}}}"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(a: Column, w: Column) -> Column:
        t = token_count(w)
        full = (a["now"] != "") & (a["n"] + t > most)
        fresh = full | (a["now"] == "")
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(fresh, w).otherwise(F.concat(a["now"], F.lit(" "), w)).alias("now"),
            F.when(fresh, t).otherwise(a["n"] + t).alias("n"),
        )

    def cut(s: Column) -> Column:
        words = F.flatten(F.transform(F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0)), lambda w: F.when(token_count(w) > most, runs(w)).otherwise(F.array(w))))
        greedy = F.aggregate(words, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
        return F.when(token_count(s) > most, greedy).otherwise(F.array(s))

    return F.flatten(F.transform(sentences(text), cut))


def pack_sentences(text: Column, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Greedy chunks of sentences, none of more than ``most`` tokens; a chunk begins
    with the last piece of the one before where that has at most ``overlap`` tokens."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"), F.lit("").alias("last"), F.lit(0).alias("last_n"))

    def step(a: Column, s: Column) -> Column:
        t = token_count(s)
        full = (a["n"] > 0) & (a["n"] + t > most)
        carry = full & (a["last_n"] <= overlap) & (a["last_n"] + t <= most)
        base = F.when(carry, a["last"]).when(full, F.lit("")).otherwise(a["now"])
        base_n = F.when(carry, a["last_n"]).when(full, F.lit(0)).otherwise(a["n"])
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(base == "", s).otherwise(F.concat(base, F.lit(" "), s)).alias("now"),
            (base_n + t).alias("n"), s.alias("last"), t.alias("last_n"),
        )

    return F.aggregate(bounded_pieces(text, most), start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def keep_or_split(df: DataFrame, id_col: str, text_col: str, most: int = MAX_TOKENS) -> DataFrame:
    """Texts within the bound unchanged, others in parts ``<id>_partN`` (from 1)."""
    long = token_count(F.col(text_col)) > most
    parts = F.when(long, pack_sentences(F.col(text_col), most)).otherwise(F.array(F.col(text_col)))
    out = df.withColumn("long", long).select(*[c for c in df.columns if c != text_col], "long", F.posexplode(parts).alias("part", text_col))
    sub = F.when(F.col("long"), F.concat(F.col(id_col).cast("string"), F.lit("_part"), (F.col("part") + 1).cast("string")))
    return out.withColumn("sub_section_id", sub).withColumn("token_length", token_count(F.col(text_col))).drop("long")


def markdown_chunks(files: DataFrame, id_col: str, text_col: str, most: int = MAX_TOKENS) -> DataFrame:
    """Heading nodes, long ones split, each with its own title."""
    nodes = files.select(id_col, F.posexplode(header_nodes(F.col(text_col))).alias("node", text_col))
    return keep_or_split(nodes, id_col, text_col, most).withColumn("section_title", first_line_title(F.col(text_col)))


def pack_segments(segments: Column, most: int = MAX_TOKENS, margin: float = 1.1) -> Column:
    """Greedy groups of timed segments (``struct<text, start, duration>``); a group
    closes before the segment that would take it past ``most * margin`` tokens."""
    limit = most * margin
    group = "array<struct<text:string,start:double,end:double>>"
    start = F.struct(F.array().cast(group).alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    close = lambda a: F.concat(a["done"], F.array(F.struct(a["text"].alias("text"), a["start"].alias("start"), a["end"].alias("end"))))

    def step(a: Column, s: Column) -> Column:
        t = token_count(s["text"])
        full = (a["text"] != "") & (a["n"] + t > limit)
        fresh = full | (a["text"] == "")
        return F.struct(
            F.when(full, close(a)).otherwise(a["done"]).alias("done"),
            F.when(fresh, s["text"]).otherwise(F.concat(a["text"], F.lit(" "), s["text"])).alias("text"),
            F.when(fresh, t).otherwise(a["n"] + t).alias("n"),
            F.when(fresh, s["start"]).otherwise(a["start"]).alias("start"),
            (s["start"] + s["duration"]).alias("end"),
        )

    told = F.filter(segments, lambda s: strip(s["text"]) != "")
    return F.aggregate(told, start, step, lambda a: F.when(a["text"] == "", a["done"]).otherwise(close(a)))


def collect_between(chapters: DataFrame, segments: DataFrame, by: str) -> DataFrame:
    """Text of all segments that overlap each chapter, in order; chapters without any keep ''."""
    s = segments.select(F.col(by).alias("s_by"), F.col("start").alias("s_start"), (F.col("start") + F.col("duration")).alias("s_end"), F.col("text").alias("s_text"))
    hit = (F.col(by) == F.col("s_by")) & (F.col("s_end") > F.col("start_time")) & (F.col("s_start") < F.col("end_time"))
    texts = F.sort_array(F.collect_list(F.when(F.col("s_text").isNotNull(), F.struct("s_start", "s_text"))))
    return chapters.join(s, hit, "left").groupBy(by, "chapter", "start_time", "end_time").agg(F.array_join(F.transform(texts, lambda x: x["s_text"]), " ").alias("text"))


def chapter_ends(own: Column, following: Column, total: Column) -> Column:
    return F.coalesce(own, following, total)


def total_duration(meta: Column, segments: Column) -> Column:
    last = F.try_element_at(segments, F.lit(-1))
    return F.coalesce(meta, last["start"] + last["duration"], F.lit(0.0))


def with_pseudo_chapter(chapters: Column, total: Column, text: Column) -> Column:
    """One untitled chapter of the whole text where there is none."""
    one = F.array(F.struct(F.lit(0.0).alias("start_time"), F.lit(None).cast("string").alias("title"), total.alias("end_time"), text.alias("text")))
    return F.when(F.coalesce(F.size(chapters), F.lit(0)) <= 0, one).otherwise(chapters)


def video_chunks(videos: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """Description, then titled chapters, else groups of segments.

    ``videos``: video_id, description, chapters, segments.
    """
    vid = F.col("video_id")
    described = videos.select(vid, F.posexplode(pack_sentences(F.coalesce("description", F.lit("")), most)).alias("i", "text")).select("video_id", F.lit("description").alias("source"), F.concat(vid, F.lit("_desc_"), F.col("i").cast("string")).alias("section_id"), "text")
    titled = F.exists(F.coalesce("chapters", F.array().cast("array<struct<start_time:double,title:string,end_time:double,text:string>>")), lambda c: c["title"].isNotNull())
    ch = videos.filter(titled).select(vid, F.posexplode("chapters").alias("c", "chapter")).filter(strip(F.coalesce(F.col("chapter.text"), F.lit(""))) != "")
    parts = ch.select(vid, "c", F.posexplode(pack_sentences(F.col("chapter.text"), most)).alias("i", "text")).select("video_id", F.lit("chapter").alias("source"), F.concat(vid, F.lit("_ch"), (F.col("c") + 1).cast("string"), F.lit("_part"), F.col("i").cast("string")).alias("section_id"), "text")
    rest = videos.filter(~titled).select(vid, F.posexplode(pack_segments(F.col("segments"), most)).alias("i", "g")).select("video_id", F.lit("transcript_fallback").alias("source"), F.concat(vid, F.lit("_seg"), F.col("i").cast("string")).alias("section_id"), F.col("g.text").alias("text"))
    return described.unionByName(parts).unionByName(rest).withColumn("token_length", token_count(F.col("text"), 2))


def token_stats(df: DataFrame, column: str = "token_length") -> DataFrame:
    return df.agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.sum(column).alias("total"))


def over_long(df: DataFrame, text_col: str, most: int = 512) -> DataFrame:
    return df.withColumn("token_length", token_count(F.col(text_col))).filter(F.col("token_length") > most)
