"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Language ID drops what has no clear language; the n-gram join keeps one document of each group of near duplicates; secrets are
replaced by their kind; documents are repeated to mix the languages; the rest is packed into bins.

Nulls: a null or empty text has no letter, so the first stage drops it; a null id is no near duplicate and is mixed and packed like
any; a null language or source is learned from by none and is a source of its own. Rows that share an id stay or go together, wholly
repeated ones are kept once. Very long texts are taken whole and packed in pieces. An empty table gives none. Extra columns pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytoloom.llm.language_id import keep_identified
from cytoloom.llm.mixing import repeat_to_mix
from cytoloom.llm.ngram_join import keep_one
from cytoloom.llm.packing import pack_documents
from cytoloom.llm.secrets import redact
from cytoloom.llm.staging import Staging


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_to_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("language", identify), ("near duplicates", deduplicate), ("secrets", scrub), ("mixing", mix), ("packing", pack)]

#: Classifiers and best-fit packing are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
