"""The corpus pipeline: language ID, exact dedup, n-gram join, mixing, packing. Each stage's rows are written and read again; an empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm import exact_dedup, language_id, mixing, ngram_join, packing, shared


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the models don't reject; where lang is null, the language found takes its place. Null texts and those without letters go.

    They are written here, as texts go to workers in smaller batches then.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "lang"]
    found = language_id.identify(docs, language_id.train(docs)).filter("not rejected")
    named = found.select(*columns, F.coalesce("lang", "lang_pred").alias("lang")).select(*[F.col(f"`{c}`") for c in docs.columns])
    return shared.written(named, "languages", batch_rows=shared.BATCH_ROWS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row of the largest id; nulls count as empty texts and as the least ids."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram links connect, one row of the least id, null ids last; texts without words all stay."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their leaf's budget takes them; one taken in several epochs has a row for each, and the last of a leaf keeps the tokens that the budget has left. Null levels are a leaf of their own; texts without tokens go."""
    return mixing.mixed_documents(docs, mixing.production_levels(), mixing.production_weight)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their token ids, and the sequences that they are packed into. Empty texts have none."""
    return packing.pack_tokens(docs)


STAGES = [
    ("language ID", identify_languages),
    ("exact dedup", drop_copies),
    ("n-gram join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


ORACLE_SQL = None
