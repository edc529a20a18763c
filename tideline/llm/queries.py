"""Queries and SQL of the llm operators, as registered by the entry module."""

from __future__ import annotations

from tideline.llm import decontam, html_extract, langid, licenses, mixing, near_dedup, pii, quality, secrets, substring_dedup
from tideline.llm.common import documents


def op1_secrets(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir))


def op2_langid(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op3_near_dedup(spark, sf_dir):
    return near_dedup.group_near_duplicates(documents(spark, sf_dir))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(documents(spark, sf_dir))


def op5_pii(spark, sf_dir):
    return pii.pseudonymize(documents(spark, sf_dir))


def op6_mixing(spark, sf_dir):
    return mixing.rounded(documents(spark, sf_dir))


def op7_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir))


def op8_html(spark, sf_dir):
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_decontam(spark, sf_dir):
    return decontam.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_licenses(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_langid, op3_near_dedup, op4_substring_dedup, op5_pii, op6_mixing, op7_quality, op8_html, op9_decontam, op10_licenses)}
ORACLES = {"op6_mixing": mixing.oracle(), "op7_quality": quality.ORACLE, "op10_licenses": licenses.oracle()}
