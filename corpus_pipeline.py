"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Language ID drops texts without a language, exact and near dedup keep one document of each group, mixing repeats or
leaves out documents so that sources come to their target weights, and packing places what is left in bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medloom.llm.common import discard, stage, table, written
from medloom.llm.exact_dedup import exact_dedup
from medloom.llm.language_id import language_filter
from medloom.llm.mixing import mix
from medloom.llm.near_dedup import near_dedup
from medloom.llm.packing import pack


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language_id", identify), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: SQL can't express these stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        with stage() as keep:  # a stage's own steps go when what came of them is written
            docs = written(step(spark, docs, sf_dir), name)
            keep(docs)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
