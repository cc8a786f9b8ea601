"""A training corpus from ``documents``: five stages, each over all rows that the one before kept.

1. language: rows whose language the classifier rejects go.
2. near duplicates: one document of each class stays.
3. repeated passages: sentences under a span that came before go; a document
   that loses all its sentences stays as an empty text.
4. mixing: rows in the order of the schedule that gives sources their weights.
   The mix (blocks and weight of each source) goes along in the metadata of
   ``source``, as files don't keep the order of rows.
5. encoding: ids of every text, with whether they decode to it, and its
   ``slot`` and ``place`` in the mix that the fourth stage settled. Rows that
   were not mixed have neither.

All stages but the last return the columns of ``documents``, and any others
that their input has, whatever their names. A null text has no language, so the
first stage lets it go, as it does texts without a letter; by themselves the
others keep both. Rows with a null id are documents like others. Of repeated rows the
second stage keeps one, ties going to the least id, then text, then a hash of
the other columns. Texts of any length are worked on whole, and an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import langid, mixing, nearedup, spans, unigram
from arbora.llm.arrowtext import checkpointed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spans.dedup_documents(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unigram.encode(mixing.mixed(docs, "doc_id", "text"), carried=("slot", "place"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("encoded", encoded),
]

#: The stages are trained, sampled and hashed, which SQL can't express; the tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = checkpointed(docs) if k < len(STAGES) - 1 else docs
    return docs
