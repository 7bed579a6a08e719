"""Lexical, vector and fused retrieval over DataFrames.

Queries come as a table, so a batch of any size is one plan.  Ranks are columns
and every order ends in the chunk's key, so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronsift.functions.text import or_else, seconds

#: Fixed values of the retrieval modes.
K_SEMANTIC, K_BM25, BOOST, RRF_K, TOP_AFTER_RRF, TOP_FINAL, SCORE_THRESHOLD = 20, 20, 5.0, 120, 10, 5, -3.0
K1, B = 1.5, 0.75
DIMS = 64
MODES = ("bm25", "vector", "bm25_vector", "bm25_vector_fusion", "bm25_vector_fusion_rerank")


def terms(text: Column) -> Column:
    """Lower-cased runs of two or more letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def bm25_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> dict[str, DataFrame]:
    """Postings with term and document lengths, and document frequencies.

    ``tf``: chunk_id, term, tf, dl; ``df``: term, df; ``stats``: one row with n, avgdl.
    """
    t = terms(F.col(text_col))
    # Terms are worked out below the explosion, else their number would be worked out per term.
    tf = chunks.select(F.col(id_col).alias("chunk_id"), t.alias("ts")).select("chunk_id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(t)).alias("avgdl"))
    return {"tf": tf, "df": tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "stats": stats}


def store_index(index: dict[str, DataFrame], path: str) -> None:
    """Write an index; postings of a term stand together, so a query's terms read few row groups."""
    index["tf"].repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/tf")
    index["df"].repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/df")
    index["stats"].coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("tf", "df", "stats")}


def _shown(score: Column, digits: int | None) -> Column:
    """Scores are ranked as they are, or rounded where other engines must agree."""
    return score if digits is None else F.round(score, digits)


def top(df: DataFrame, k: int, tie: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows per query with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(index: dict[str, DataFrame], queries: DataFrame, k: int = K_BM25, digits: int | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank``.

    Only postings of query terms are scored: the terms of the query batch reduce
    the postings before any join with them is shuffled.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    n, avgdl = index["stats"].first()  # two numbers
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = q.join(index["df"], "term").withColumn("idf", idf)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0))
    hits = index["tf"].join(weighted, "term").withColumn("part", F.col("idf") * F.col("tf") / norm)
    scored = hits.groupBy("query_id", "chunk_id").agg(_shown(F.sum("part"), digits).alias("score"))
    return top(scored, k)


def boosted(hits: DataFrame, queries: DataFrame, titles: DataFrame, boost: float = BOOST, match: str = "substring") -> DataFrame:
    """Add ``boost`` once where a query word is found in the chunk's title; rank again."""
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")
    title = F.lower(F.coalesce("title", F.lit("Unknown section")))
    found = F.exists(words, lambda w: title.contains(w)) if match == "substring" else F.arrays_overlap(words, F.split(title, r"\s+"))
    j = hits.drop("rank").join(queries, "query_id").join(titles.select("chunk_id", "title"), "chunk_id", "left")
    return top(j.withColumn("score", F.col("score") + F.when(found, boost).otherwise(0.0)).select("query_id", "chunk_id", "score"), 1 << 30)


def hashed_embedding(chunks: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """Stand-in embedder: terms hashed into ``dims`` buckets, unit length; sparse rows."""
    bucket = F.pmod(F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")
    counts = chunks.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("id", bucket.alias("dim")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    return counts.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id"))))


def dense_embedding(chunks: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """``hashed_embedding`` as one vector per row: ``id, v``; texts without terms have none."""
    m = hashed_embedding(chunks, id_col, text_col, dims).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("m"))
    return m.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("v"))


#: Bytes of queries that are searched in one pass, and of vectors that a task measures at once.
QUERY_BYTES, VECTOR_BYTES = 32 << 20, 32 << 20


def _unit(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of unit length, and which of them are not zero."""
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)
    norm = np.sqrt((x * x).sum(1))
    fine = np.flatnonzero(norm > 0)
    return x[fine] / norm[fine, None], fine


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = K_SEMANTIC, digits: int | None = None) -> DataFrame:
    """Cosine top ``k``: all vectors against a stated batch of queries.

    ``vectors``: chunk_id, v; ``queries``: query_id, v, all of one length; null and
    zero vectors take no part.  Queries go to the tasks in blocks of ``QUERY_BYTES``
    at most, a pass over the vectors each; a task sends on ``k`` rows a query (and
    ties) for every ``VECTOR_BYTES`` of vectors.
    """
    spark = vectors.sparkSession
    asked = queries.select("query_id", "v").filter("v is not null")
    size = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-size[0] * size[1] * 8 // QUERY_BYTES))
    kinds = dict(vectors.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    narrow = vectors.select("chunk_id", "v").filter("v is not null")

    def against(ids: pa.Array, q: np.ndarray):
        def best(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            x, fine = _unit(t.column(1))
            score = q @ x.T
            score = score if digits is None else np.round(score, digits)
            n = score.shape[1]
            least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
            rows, cols = np.nonzero(score >= least[:, None])
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), t.column(0).combine_chunks().take(pa.array(fine[cols])), pa.array(score[rows, cols])], ["query_id", "chunk_id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                if b.num_rows:
                    held.append(b)
                if sum(x.nbytes for x in held) >= VECTOR_BYTES:
                    yield best(held)
                    held = []
            if held:
                yield best(held)

        return run

    found = spark.createDataFrame([], f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # bounded by QUERY_BYTES
        if part.num_rows:
            q, fine = _unit(part.column(1))
            ids = part.column(0).combine_chunks().take(pa.array(fine))
            found = found.unionByName(narrow.mapInArrow(against(ids, q), f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double"))
    return top(found, k)


def first_of(lists: list[DataFrame]) -> DataFrame:
    """Union of ranked lists without repeats; the first list's hit wins, then the better rank."""
    both = lists[0].withColumn("list_no", F.lit(0))
    for k, x in enumerate(lists[1:], 1):
        both = both.unionByName(x.withColumn("list_no", F.lit(k)), allowMissingColumns=True)
    one = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("list_no", "rank"))
    return both.withColumn("one", one).filter("one = 1").drop("one")


def reciprocal_fusion(lists: list[DataFrame], k: int = RRF_K, keep: int = TOP_AFTER_RRF, digits: int | None = None) -> DataFrame:
    """Reciprocal rank fusion; a key repeated in a list counts at its best rank."""
    parts = [x.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank")) for x in lists]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return top(both.groupBy("query_id", "chunk_id").agg(_shown(F.sum(1.0 / (k + F.col("rank"))), digits).alias("score")), keep)


def coverage_rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = TOP_FINAL, threshold: float | None = None) -> DataFrame:
    """Stand-in reranker: share of the query's terms that the chunk holds, then the fused score."""
    q = F.array_distinct(terms(F.col("query")))
    j = hits.join(queries, "query_id").join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id")
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms(F.col("chunk_text")))) / F.size(q)).otherwise(0.0)
    rows = j.select("query_id", "chunk_id", share.alias("rerank"), F.col("score").alias("fused"))
    if threshold is not None:
        rows = rows.filter(F.col("rerank") > threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), F.desc("fused"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rerank").alias("score"), "rank")


def rerank_chain(*scorers):
    """A reranker that takes the first scorer that can be called, else the fused order cut at ``k``."""

    def run(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = TOP_FINAL) -> DataFrame:
        for scorer in scorers:
            try:
                return scorer(hits, queries, chunks, k)
            except (ImportError, OSError):  # a model that is not there
                continue
        return hits.filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")

    return run


def retrieve(index: dict[str, DataFrame], vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, mode: str = MODES[-1], k: int = TOP_FINAL, rerank=coverage_rerank, digits: int | None = None) -> DataFrame:
    """Route a batch of queries by mode; an unknown mode runs the whole pipeline.

    ``chunks``: chunk_id, text, title.  ``rerank`` may be any function of that form.
    """
    mode = (mode or "").strip().lower()
    tagged = lambda df, name: df.withColumn("retriever", F.lit(name))
    if mode == "bm25":
        return tagged(bm25(index, queries, digits=digits).filter(F.col("rank") <= k), "bm25")
    if mode == "vector":
        return tagged(vector_top(vectors, query_vectors, digits=digits).filter(F.col("rank") <= k), "vector")
    if mode == "bm25_vector":
        half = -(-k // 2)
        lists = [tagged(bm25(index, queries, digits=digits).filter(F.col("rank") <= half), "bm25"), tagged(vector_top(vectors, query_vectors, digits=digits).filter(F.col("rank") <= k - half), "vector")]
        w = Window.partitionBy("query_id").orderBy("list_no", "rank")
        return first_of(lists).withColumn("rank", F.row_number().over(w)).drop("list_no")
    lexical = boosted(bm25(index, queries, digits=digits), queries, chunks)
    fused = reciprocal_fusion([vector_top(vectors, query_vectors, digits=digits), lexical], digits=None if digits is None else 9)
    if mode == "bm25_vector_fusion":
        return tagged(fused.filter(F.col("rank") <= k), "fusion")
    return tagged(rerank(fused, queries, chunks, k), "fusion")


def new_rows(incoming: DataFrame, stored: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Rows whose id is not stored yet."""
    return incoming.join(stored.select(id_col), id_col, "left_anti")


def node_metadata(m: Column) -> Column:
    """The plainer resolver of a metadata struct: a named PDF is one, the page is the first of three keys that is set."""
    has = or_else(m["pdf_name"]).isNotNull()
    return F.struct(F.when(has, "pdf").otherwise(F.coalesce(m["source_type"], F.lit("document"))).alias("source_type"), or_else(m["page_start"], m["page"], m["page_number"]).alias("page"), m["source_url"].alias("source_url"))


#: Keys of a hit's metadata, all strings, from which ``normalised_hits`` is filled.
HIT_KEYS = "source_type source_url pdf_name section_title page_start page total_pages video_title chapter_title start_time url markdown_file md_name md_url".split()


def normalised_hits(hits: DataFrame) -> DataFrame:
    """One wide row per hit, filled by source type: pdf, video, file help, else text.

    ``hits``: query_id, chunk_id, rank, score, text and ``HIT_KEYS``.
    """
    kind = F.lower(F.coalesce("source_type", F.lit("")))
    is_pdf, is_video = kind.contains("pdf"), kind.contains("video") & ~kind.contains("pdf")
    is_file = (kind.contains("markdown") | kind.contains("github")) & ~is_pdf & ~is_video
    number = lambda *cs: F.when(is_pdf, F.coalesce(or_else(*(F.col(c) for c in cs)).try_cast("int"), F.lit(1)))
    return hits.select(
        "query_id", "chunk_id", "rank",
        F.when(is_pdf, "pdf").when(is_video, "video").when(is_file, "markdown").otherwise("text").alias("source_type"),
        F.when(is_file, F.col("md_url")).when(~is_video, F.col("source_url")).alias("source_url"),
        F.when(is_pdf, F.replace(F.coalesce("pdf_name", F.lit("")), F.lit(".pdf"), F.lit(""))).alias("pdf_id"),
        number("page_start", "page").alias("page_number"), number("total_pages").alias("total_pages"),
        F.when(is_video, F.col("video_title")).when(is_file, or_else(F.col("markdown_file"), F.col("md_name"))).otherwise(F.col("section_title")).alias("title"),
        F.when(is_video, or_else(F.col("chapter_title"), F.col("start_time"), F.lit("video description"))).when(is_file, F.col("section_title")).alias("section"),
        F.when(is_video, F.col("url")).alias("video_link"), F.when(is_video, F.col("start_time")).alias("timestamp"),
        F.when(is_video, seconds(F.col("start_time"))).alias("second_offset"),
        "score", F.left("text", F.lit(1000)).alias("content"),
    )


def hit_label(most: int = 40) -> Column:
    """What a list of hits shows for a normalised one: rank, type, name and place."""
    name = F.coalesce(or_else(F.col("pdf_id"), F.col("title")), F.lit("unknown"))
    place = F.coalesce(or_else(F.col("section"), F.col("timestamp"), F.col("title")), F.lit("Untitled section"))
    short = F.when(F.char_length(name) > most, F.concat(F.left(name, F.lit(most)), F.lit("..."))).otherwise(name)
    return F.concat_ws(" | ", F.concat(F.lit("Rank "), F.col("rank").cast("string")), F.col("source_type"), short, place)


def context_block(hits: DataFrame, most: int = 800) -> DataFrame:
    """The hits of each query as one text: ``[rank] title (p:.. or sec:..)`` and content."""
    where = F.when(F.col("page_number").isNotNull(), F.concat(F.lit("p:"), F.col("page_number").cast("string"))).otherwise(F.concat(F.lit("sec:"), F.coalesce("section", F.lit("-"))))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", "pdf_id", F.lit("Untitled")), F.lit(" ("), where, F.lit(")"))
    block = F.concat(head, F.lit("\n"), F.left(F.trim("content"), F.lit(most)))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("context"))


PROMPT = "Answer the question from the context only.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"
NO_CONTEXT = "No documents were found; answer from general knowledge and say so.\n\nQuestion: {question}\nAnswer:"


def prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Prompt per query, the fallback where nothing was found."""
    filled = F.replace(F.replace(F.lit(PROMPT), F.lit("{context}"), F.col("context")), F.lit("{question}"), F.col("query"))
    bare = F.replace(F.lit(NO_CONTEXT), F.lit("{question}"), F.col("query"))
    return queries.join(contexts, "query_id", "left").select("query_id", "query", F.coalesce(filled, bare).alias("prompt"), F.col("context").isNull().alias("without_context"))


def echo(prompt: str) -> str:
    """Default stand-in for a language model."""
    return prompt.rsplit("Question: ", 1)[-1].removesuffix("\nAnswer:")


def generate(asked: DataFrame, client=echo) -> DataFrame:
    """Call ``client(prompt) -> str`` for each row, by batches on the executors."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(answer=pdf["prompt"].map(client))[["query_id", "answer"]]

    kind = dict(asked.dtypes)["query_id"]
    return asked.mapInPandas(run, f"query_id {kind}, answer string")


def no_summary(path: str) -> str:
    """Default stand-in for a captioning model."""
    return "(no summary)"


def captions(images: DataFrame, caption=no_summary) -> DataFrame:
    """Captions of each page's images, in order: ``file, page, images, summaries``.

    ``images``: file, page, images (paths).  A missing path gives '', a failing call ``(no summary)``.
    """

    def one(path: str | None) -> str:
        try:
            return caption(path) if path else ""
        except Exception:
            return "(no summary)"

    def run(batches):
        for pdf in batches:
            yield pdf.assign(summaries=[[one(p) for p in some] for some in pdf["images"]])

    kinds = dict(images.dtypes)
    return images.select("file", "page", "images").mapInPandas(run, f"file {kinds['file']}, page {kinds['page']}, images array<string>, summaries array<string>")
