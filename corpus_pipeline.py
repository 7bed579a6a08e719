"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of ``docs``, extra ones included, whatever their
names; the last returns pieces of packed sequences.

Defined cases: null and empty texts count as empty, are scored by quality like
any other, are one group of copies, and are dropped by the mix, as they have no
words; rows that repeat are one row after the exact stage; of rows alike in
length the smallest id stays, null ids last; very long texts are worked on
whole; an empty table, or one without words, gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronsift.llm import exact_dedup, mixing, near_copies, packing, quality
from heronsift.llm.common import written
from heronsift.llm.queries import table, vocabulary

#: Documents whose quality score is under this go.
KEEP_FROM = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), KEEP_FROM)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles of a similarity of 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("exact dedup", keep_distinct),
    ("near dedup", keep_unlike),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Compression, SimHash and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
