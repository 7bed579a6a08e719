"""Readers and writers of chunk files, lists, questions and runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronsift.functions.text import chunk_id, is_question, or_else, strip

#: Metadata keys that any source type may have; others go to ``extra``.
META_KEYS = (
    "doc_id source_type repo_name markdown_file md_name md_url source_path section_title processing_date video_id video_title author url source "
    "section_id chapter_title start_time end_time pdf_name page_start source_url sub_section_id"
).split()
META = T.StructType([*(T.StructField(k, T.StringType()) for k in META_KEYS), T.StructField("token_length", T.IntegerType())])
SECTION = T.StructType([T.StructField("text", T.StringType()), T.StructField("metadata", META)])

_LISTED = T.ArrayType(T.StringType())


def _items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``source, idx, item``: each file's sections as JSON strings.

    Accepts ``{"sections": [..]}`` and a bare list, of objects, of JSON strings or
    of plain strings; a file is one record.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("value"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("source"))
    body = F.coalesce(F.get_json_object("value", "$.sections"), F.col("value"))
    return files.select("source", F.posexplode(F.from_json(body, _LISTED)).alias("idx", "item"))


def read_chunks(spark: SparkSession, paths: str | list[str], keep_textless: bool = False) -> DataFrame:
    """``chunk_id, source, idx, text, meta`` of chunk files.

    Plain strings are texts; items without text are skipped, or kept as ''.
    """
    items = _items(spark, paths)
    parsed = F.from_json("item", SECTION, {"mode": "PERMISSIVE"})
    plain = ~F.coalesce(F.trim("item").startswith("{"), F.lit(False))
    rows = items.withColumn("p", parsed).select("source", "idx", F.when(plain, F.col("item")).otherwise(F.col("p.text")).alias("text"), F.col("p.metadata").alias("meta"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))) if keep_textless else rows.filter("text is not null")
    return rows.select(chunk_id(F.col("source"), F.col("idx"), F.col("text")).alias("chunk_id"), "source", "idx", "text", "meta")


def with_default_metadata(chunks: DataFrame) -> DataFrame:
    """What lexical retrieval expects: names and titles filled from what there is."""
    m, idx = F.col("meta"), F.col("idx").cast("string")
    return chunks.select(
        "chunk_id", "source", "idx", "text",
        or_else(m["pdf_name"], F.col("source")).alias("pdf_name"),
        or_else(m["section_title"], m["video_title"], F.lit("Unknown section")).alias("title"),
        or_else(m["section_id"], F.concat("source", F.lit("_chunk_"), idx)).alias("section_id"),
        m["source_type"].alias("source_type"), m["page_start"].alias("page_start"), m["chapter_title"].alias("chapter_title"),
        m["start_time"].alias("start_time"), m["url"].alias("url"), m["markdown_file"].alias("markdown_file"),
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON line per chunk, a folder per source."""
    chunks.write.partitionBy("source").mode("overwrite").json(path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder that all executors share; a local master may go without the setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="heronsift-")
    return f"{found.rstrip('/')}/heronsift/{label}-{uuid.uuid4().hex}"


def write_sections(chunks: DataFrame, path: str, most: int = 10_000) -> None:
    """``{"sections": [{text, metadata}]}`` records, a folder per source, of ``most`` sections each."""
    drop = {"chunk_id", "source", "idx", "text", "meta", "key", "part"}
    own = [c for c in chunks.columns if c not in drop]
    meta = F.struct(*([F.col(f"meta.{f.name}").alias(f.name) for f in META.fields if f.name not in own] if "meta" in chunks.columns else []), *own)
    place = [c for c in ("idx", "part") if c in chunks.columns]
    part = F.floor(F.col("idx") / most) if "idx" in chunks.columns else F.lit(0)
    rows = chunks.select("source", part.alias("record"), F.struct(*place, "text", meta.alias("metadata")).alias("x"))
    whole = rows.groupBy("source", "record").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["text"].alias("text"), x["metadata"].alias("metadata"))).alias("sections")).drop("record")
    whole.repartition("source").write.option("maxRecordsPerFile", 1).mode("overwrite").partitionBy("source").json(path)


def write_section_list(sections: DataFrame, path: str) -> None:
    """One JSON line per section: ``text`` and ``metadata`` without null and empty values."""
    sections.select("source", "text", "metadata").write.mode("overwrite").partitionBy("source").option("ignoreNullFields", True).json(path)


def write_markdown(pages: DataFrame, path: str) -> None:
    """One Markdown text per file, each in a folder of its own."""
    pages.select("file", "markdown").write.mode("overwrite").partitionBy("file").text(path)


def one_target(chunks: DataFrame, name: str) -> DataFrame:
    """The rows of the first source (by name) that holds ``name``, case ignored."""
    first = chunks.filter(F.lower("source").contains(name.lower())).agg(F.min("source")).first()[0]
    return chunks.filter(F.col("source") == first) if first is not None else chunks.limit(0)


def pdf_files(files: DataFrame, target: str | None = None) -> DataFrame:
    """Rows of ``name`` that end in .pdf, case ignored; with a target only that name, case ignored."""
    kept = files.filter(F.lower("name").endswith(".pdf"))
    return kept if target is None else kept.filter(F.lower("name") == target.lower())


def read_downloads(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of downloads: a row per file with its place, success and size."""
    return spark.read.schema("name string, source_url string, local_path string, success boolean, filesize_bytes long, timestamp string").option("multiLine", True).json(path)


def video_info(raw: DataFrame) -> DataFrame:
    """Eight fields of a fetched video; a null description is '', null chapters are none."""
    none = F.array().cast("array<struct<start_time:double,title:string,end_time:double>>")
    return raw.select(F.col("id").alias("video_id"), "url", "title", F.coalesce("description", F.lit("")).alias("description"), F.col("uploader").alias("author"), F.col("upload_date").alias("publish_date"), "duration", F.coalesce("chapters", none).alias("chapters"))


def get_or_create(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows stored under ``path``; an empty store is made where there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], schema).coalesce(1).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def cached_captions(spark: SparkSession, images: DataFrame, path: str, caption) -> DataFrame:
    """Captions of pages that the store under ``path`` lacks are made and added; all stored rows of these pages."""
    store = get_or_create(spark, path, "file string, page int, images array<string>, summaries array<string>")
    new = images.join(store.select("file", "page"), ["file", "page"], "left_anti")
    caption(new).write.mode("append").parquet(path)
    return spark.read.schema(store.schema).parquet(path).join(images.select("file", "page").distinct(), ["file", "page"], "left_semi")


def read_repositories(spark: SparkSession, path: str, folder: str = "inst/help") -> DataFrame:
    """``repo, folder`` of a repository list."""
    shape = "github array<struct<source_type:string,repo:string,folder:string,source_url:string>>"
    return spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("github").alias("g")).select("g.repo", F.coalesce("g.folder", F.lit(folder)).alias("folder"), "g.source_url")


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    shape = "videos array<struct<name:string,url:string,category:string,language:string>>"
    return spark.read.schema(shape).option("multiLine", True).json(path).select(F.inline("videos"))


def listed_files(df: DataFrame, name: str, repo: str) -> DataFrame:
    """Markdown files that are not localised, renamed ``owner_repo__name``."""
    kept = df.filter(F.col(name).endswith(".md") & ~F.col(name).contains("_nl"))
    return kept.withColumn("local_name", F.concat(F.replace(F.col(repo), F.lit("/"), F.lit("_")), F.lit("__"), F.col(name)))


def caption_segments(json: str) -> Column:
    """``array<struct<text, start, duration>>`` from a caption track's JSON."""
    shape = "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>"
    made = F.transform(F.coalesce(F.from_json(json, shape)["events"], F.array()), lambda e: F.struct(strip(F.array_join(F.transform(e["segs"], lambda s: s["utf8"]), "")).alias("text"), (e["tStartMs"] / 1000.0).alias("start"), (F.coalesce(e["dDurationMs"], F.lit(0.0)) / 1000.0).alias("duration")))
    return F.filter(made, lambda s: F.coalesce(s["text"], F.lit("")) != "")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question lines of text files, numbered ``q_1..n`` in order, with empty judgements."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")).filter(is_question(F.col("line")))
    return question_template(lines, "line_no", "line")


def question_template(lines: DataFrame, order: str, line: str) -> DataFrame:

    n = F.row_number().over(Window.orderBy(order))  # a hand-written list of questions
    return lines.select(F.concat(F.lit("q_"), n.cast("string")).alias("id"), strip(F.col(line)).alias("query"), F.lit(None).cast("boolean").alias("answerable"), F.lit(None).cast("string").alias("ground_truth_answer"), F.array().cast("array<string>").alias("relevant_chunk_ids"))


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    shape = "id string, query string, answerable boolean, ground_truth_answer string, relevant_chunk_ids array<string>"
    return spark.read.schema(shape).option("multiLine", True).option("mode", "PERMISSIVE").json(path).filter("query is not null")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """CSV of judged rows; all strings, to be cleaned by ``clean_judgements``."""
    names = {"QID": "qid", "Question": "question", "Difficulty Level": "difficulty", "Retrieval Mode": "mode", "Rank": "rank", "Retrieved Doc": "doc", "Relevance": "relevance", "Gold Standard Set": "gold"}
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items()))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def page_images(images: DataFrame, skip: int = 2, least: int = 150) -> DataFrame:
    """Images of each page but the first ``skip``, large enough; pages from 1."""

    n = F.row_number().over(Window.partitionBy("file", "page").orderBy("image_no"))
    kept = images.withColumn("n", n).filter((F.col("n") > skip) & (F.col("width") >= least) & (F.col("height") >= least))
    return kept.groupBy("file", (F.col("page") + 1).alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("image_no", "path"))), lambda x: x["path"]).alias("images"))


def ordered_pages(pages: DataFrame) -> DataFrame:
    """Pages of each file in order."""
    return pages.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_idx", "text"))), lambda x: x["text"]).alias("pages"))
