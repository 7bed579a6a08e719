"""Corpus builds end to end: pages, images and videos into section documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronsift.functions import text as T
from heronsift.operators import chunking as C
from heronsift.operators import retrieval as R


def pdf_sections(pages: DataFrame, banned: tuple[str, ...] = ()) -> DataFrame:
    """``file, page, section_no, title, content`` of ``pages`` (file, page, text), cleaned page by page."""
    one = pages.select(F.struct("file", "page").alias("at"), T.clean_page(F.col("text"), banned).alias("text"))
    cut = T.sections(one, "at", "text", F.col("at.page"))
    content = T.drop_numeric_tables(T.rewrite_equations(F.col("content")))
    return cut.select("at.file", "at.page", F.col("section_no").cast("int").alias("section_no"), "title", T.strip(content).alias("content"))


def pdf_documents(pages: DataFrame, banned: tuple[str, ...] = (), start_marker: str | None = None) -> DataFrame:
    """Section documents of each file: titled sections with ids, placeholders and token counts, from a marker on.

    A file's sections are numbered by page, then place; those before the marker's section go.
    """
    s = pdf_sections(pages, banned).filter("title is not null")
    n = F.row_number().over(Window.partitionBy("file").orderBy("page", "section_no")) - 1  # one file's sections
    s = s.withColumn("n", n)
    if start_marker is not None:
        first = s.filter(F.col("title") == start_marker).groupBy("file").agg(F.min("n").alias("first"))
        s = s.join(first, "file", "left").filter(F.col("n") >= F.coalesce("first", F.lit(0))).drop("first")
    bare = F.regexp_replace("title", r" \(page [^)]*\)$", "")
    mark = T.placeholder(T.slug(F.col("title")))
    text = F.concat("content", F.lit("\n\n# "), "title", F.lit("-IMAGE DESCRIPTIONS\n"), mark)
    return s.select(
        "file", F.concat("file", F.lit(".pdf")).alias("pdf_name"), "n", "page", F.col("page").cast("string").alias("page_start"), bare.alias("section_title"),
        T.section_id(bare, F.col("page")).alias("section_id"), T.placeholders(text).alias("image_placeholders"), text.alias("text"), C.token_count(text).alias("token_length"),
    )


def with_images(documents: DataFrame, images: DataFrame, sources: DataFrame | None = None, caption=R.no_summary) -> DataFrame:
    """Documents with the descriptions of their pages' images, new token counts and where the file came from.

    ``images``: file, page, images.  Captions are made once per page.
    """
    told = R.captions(images, caption)
    place = T.dispatch_images(documents.select("file", F.col("n").alias("section_no"), F.col("page").cast("long").alias("page")), images.select("file", F.col("page").alias("image_page"), "images"), "file")
    said = place.select("file", F.col("section_no").alias("n"), "image_page", F.col("images").alias("image_paths"))
    said = said.join(told.select("file", F.col("page").cast("long").alias("image_page"), "summaries"), ["file", "image_page"], "left").drop("image_page")
    j = documents.join(said, ["file", "n"], "left").withColumn("image_summaries", F.coalesce("summaries", F.array().cast("array<string>"))).drop("summaries")
    out = j.withColumn("text", T.with_descriptions(F.col("text"), F.col("image_summaries")))
    out = out.withColumn("token_length", C.token_count(F.col("text")))
    return out if sources is None else T.source_lookup(out, sources.withColumnRenamed("name", "file"), "file")


def video_documents(videos: DataFrame, most: int = C.MAX_TOKENS) -> DataFrame:
    """Chunks of fetched videos: ``video_id, description, duration, chapters`` and ``segments``.

    Chapters get their ends and their text; without any there is one untitled chapter.
    """
    total = C.total_duration(F.col("duration"), F.col("segments"))
    v = videos.withColumn("total", total.cast("double"))
    opened = v.select("video_id", "total", F.posexplode("chapters").alias("chapter", "c"))
    following = F.lead("c.start_time").over(Window.partitionBy("video_id").orderBy("chapter"))
    ends = C.chapter_ends(F.col("c.end_time"), following, F.col("total"))
    told = opened.select("video_id", "chapter", F.col("c.title").alias("title"), F.col("c.start_time").alias("start_time"), ends.alias("end_time"))
    heard = v.select("video_id", F.inline("segments"))
    texts = C.collect_between(told, heard, "video_id").join(told.select("video_id", "chapter", "title"), ["video_id", "chapter"])
    whole = texts.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("chapter", "start_time", "title", "end_time", "text"))).alias("cs"))
    chapters = F.transform("cs", lambda c: F.struct(c["start_time"].alias("start_time"), c["title"].alias("title"), c["end_time"].alias("end_time"), c["text"].alias("text")))
    all_text = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    done = v.join(whole, "video_id", "left").withColumn("chapters", C.with_pseudo_chapter(F.coalesce(chapters, F.slice(chapters, 1, 0)), F.col("total"), all_text))
    return C.video_chunks(done.select("video_id", "description", "chapters", "segments"), most)


def write_new_videos(spark: SparkSession, videos: DataFrame, path: str) -> None:
    """Append videos that the folder lacks, a folder per video; done ones are skipped."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        videos = R.new_rows(videos, spark.read.option("basePath", path).json(path).select(F.col("video_id").cast("string").alias("video_id")).distinct(), "video_id")
    videos.write.mode("append").partitionBy("video_id").json(path)
