"""The training-data pipeline: five operators of tideline.llm in sequence.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. Rows that a stage rejects are gone for the next one, texts it changes stay
changed. `run` writes each stage's result to the shared folder and reads it again, so that a
lost executor never repeats earlier stages; what a stage wrote on its way is deleted then.

Cases that hold for all stages: texts of any length are taken whole; an empty table gives an empty
one; other columns pass, whatever their names; rows that repeat a doc_id are judged row by row,
unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontam, mixing, near_dedup, pii, quality
from tideline.llm.common import cut, documents, passing_cuts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are not depleted, without lines too common in their source.

    Null and empty texts fail; a null source is a source of its own.
    """
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group.

    Rows that repeat a doc_id are one document, of which one row stays; texts without words are in
    no group and stay; of a group in which no row has a doc_id one row stays.
    """
    return near_dedup.clean(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item. Null and empty texts stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data. Null texts stay null."""
    return pii.clean(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their raked probabilities, with the probability as column prob (prob_ beside
    a prob). Texts without words, and rows without doc_id, are never sampled; rows of one doc_id share
    their draw.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]

#: Surrogates and signatures have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        with passing_cuts(spark):
            docs = cut(stage(spark, docs, sf_dir), result=True)
    return docs
