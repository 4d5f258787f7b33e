"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; ``run`` writes each result to the shared folder and
reads it again for the next.  All but the last return the columns of
``documents``.

Edge cases, of every stage but packing: columns that ``documents`` has beyond
those of its contract travel along, whatever their names and types; an empty
table gives an empty one.  Null texts go in the first stage.  Null and equal ids
are rows like others: of rows that are near duplicates, repeated ones among
them, one stays, that with the smallest id, a null id being the largest; and
rows with equal ids, or without an id, take no passages from each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyflow.llm import decontaminate, exchange, langid, near_dup, packing, substring_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; null texts, texts without a letter and narrow margins go."""
    model = langid.learn(docs, "doc_id", "text", "lang", ~langid.held_out())
    return langid.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id; of repeated rows one."""
    return near_dup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a document that lost all its words goes."""
    return substring_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, benchmark)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("contamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: compression, MinHash and bin completion are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        past, docs = docs, exchange.materialize(stage(spark, docs, sf_dir), name)
        exchange.discard(past)
    return docs
