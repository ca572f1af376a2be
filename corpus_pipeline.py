"""The corpus pipeline: stages over documents, each written as Parquet and reread.

quality rules -> exact dedup -> near dedup -> mixing -> packing. All but the
last return the columns of documents. A stage's input is written, so what the
stages before it kept in the shared folder goes when it begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paramloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from paramloom.llm.scratch import Scratch, as_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_stage(docs, lambda: quality.filter_quality(spark, docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_stage(docs, lambda: exact_dedup.drop_copies(spark, docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_stage(docs, lambda: near_dedup.keep_one(spark, docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_stage(docs, lambda: mixing.sample(spark, docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_stage(docs, lambda: packing.pack(spark, docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]
#: Packing reads token ids, which SQL can't express; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for number, (name, stage) in enumerate(STAGES):
        label = f"{number}-{name}"
        docs = scratch.save(stage(spark, docs, sf_dir), label)
        if before:
            scratch.drop(before)
        before = label
    return docs
