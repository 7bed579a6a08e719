"""One question at a time: what an API or a command line calls."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronsift.operators import retrieval as R
from heronsift.sources import chunks as S


class EmptyQuery(ValueError):
    """The question has no visible character."""


@dataclass
class Corpus:
    """Chunks with their lexical index and vectors, made once and kept."""

    chunks: DataFrame  # chunk_id, text, title and R.HIT_KEYS
    index: dict[str, DataFrame]
    vectors: DataFrame
    embed: Any = None  # (table, id, text) -> id, v

    @classmethod
    def of(cls, chunks: DataFrame, embed=None) -> Corpus:
        embed = embed or R.dense_embedding
        kept = chunks.dropDuplicates(["chunk_id"]).persist()
        index = {name: df.persist() for name, df in R.bm25_index(kept).items()}
        vectors = embed(kept, "chunk_id", "text").withColumnRenamed("id", "chunk_id").persist()
        return cls(kept, index, vectors, embed)

    @classmethod
    def read(cls, spark: SparkSession, paths: str | list[str], embed=None) -> Corpus:
        """From chunk files."""
        c = S.read_chunks(spark, paths)
        have = {f.name for f in S.META.fields}
        keys = [(F.col(f"meta.{k}") if k in have else F.lit(None).cast("string")).alias(k) for k in R.HIT_KEYS]
        title = S.with_default_metadata(c).select("chunk_id", "title")
        return cls.of(c.select("chunk_id", "text", *keys).join(title, "chunk_id"), embed)


def modes() -> list[str]:
    """The retrieval modes that can be asked for."""
    return list(R.MODES)


def retrieve(corpus: Corpus, query: str, mode: str = R.MODES[-1], k: int = R.TOP_FINAL, rerank=R.coverage_rerank) -> list[dict]:
    """Normalised hits of one question, best first; blank questions are refused."""
    query = (query or "").strip()
    if not query:
        raise EmptyQuery("the query must not be empty")
    spark = corpus.chunks.sparkSession
    asked = spark.createDataFrame([(0, query)], "query_id long, query string")
    hits = R.retrieve(corpus.index, corpus.vectors, asked, corpus.embed(asked, "query_id", "query").withColumnRenamed("id", "query_id"), corpus.chunks, mode, k, rerank)
    wide = hits.join(corpus.chunks.drop("title"), "chunk_id")
    return [r.asDict() for r in R.normalised_hits(wide).drop("query_id").orderBy("rank").collect()]  # k rows


def answer(corpus: Corpus, query: str, model: str = "echo", mode: str = R.MODES[-1], client=R.echo) -> dict:
    """Question, model, mode, answer and sources; a failing retrieval leaves no sources."""
    try:
        found = retrieve(corpus, query, mode)
    except Exception:
        found = []
    sources = [d | {"rank": i, "text": d.get("content") or ""} for i, d in enumerate(found, 1)]
    spark = corpus.chunks.sparkSession
    asked = spark.createDataFrame([(0, query)], "query_id long, query string")
    if sources:
        rows = [(0, d["rank"], d["title"], d["pdf_id"], d["page_number"], d["section"], d["content"]) for d in sources]
        context = R.context_block(spark.createDataFrame(rows, "query_id long, rank int, title string, pdf_id string, page_number int, section string, content string"))
    else:
        context = spark.createDataFrame([], "query_id long, context string")
    told = R.generate(R.prompts(asked, context), client).first()
    return {"query": query, "model": model, "retrieval_mode": mode, "answer": told.answer, "sources": sources}
