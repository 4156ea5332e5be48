"""A training corpus from ``documents``: language ID, near-duplicates, repeated
passages, source mixing, packing.  Each stage is one operator of ``tessera.llm``; its
result is written and read before the next one runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chunk_dedup, langid, mixing, packing, simhash
from tessera.llm._shared import persist
from tessera.llm.queries import MIX, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no letters); the others carry the language
    predicted for them.

    Null, empty and letterless texts go; a null lang is not learned from but its document
    is predicted; repeated rows stay or go together; an empty table stays empty; columns
    beside those of documents are left behind, here and in all stages."""
    learn = docs.where(~langid.held_out("doc_id", 4, 2))
    model = langid.fit(learn.select("text", "lang"))
    found = langid.predict(docs, model, *COLUMNS)
    return found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: the smallest doc_id (a null one last),
    of equal ids the smallest text hash, of rows equal in both any one.  Null and empty
    texts are one component."""
    return simhash.keep_one(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; a document of which nothing but white space is left goes.

    Documents that lose nothing stay as they are, null and empty texts too; n_chars follows
    the text."""
    cut = chunk_dedup.dedup_substrings(docs.select(*COLUMNS))
    cut = cut.withColumn("n_chars", F.length("text").cast("bigint"))
    return cut.where((F.col("removed_bytes") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents to the sources' budgets by the weights of ``MIX``; one selected in
    two epochs comes twice.

    Null languages and sources are leaves of their own; ties in an epoch's order go by id
    and text hash, and rows equal in both are selected together."""
    return mixing.mix(docs, MIX).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens; a null or empty text is its end token alone, and
    repeated rows are packed as often as they come."""
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = persist(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Language ID and chunking have no SQL form; the tests hold every stage's result against a
#: brute-force version over the stage's own input.
ORACLE_SQL = None
