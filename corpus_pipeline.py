"""From documents to training files: toxic documents go, one of each class of near duplicates stays, documents that hold
benchmark items go, sources are mixed to target weights, and the mix is written as token files.

Each stage takes all rows that the one before it kept and is written as Parquet before the next reads it. Documents
keep their columns through the first four stages; the last returns what it reads back from the token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decontaminate, mixing, near_dup, token_files, toxicity
from tablewright.llm.common import staged, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.unique(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("benchmark", benchmark), ("mixing", mix), ("token files", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return docs


#: Trained scores and random draws are not SQL; the tests compare each stage with a plain version instead.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
