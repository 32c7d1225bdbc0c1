"""Registered queries of this package: ``QUERIES`` by name, ``ORACLE`` with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import (fill_middle, hilbert_packing, language_crf, license_zstd, line_spread, merge_path, mixing, pii,
                           pivot_search, ppm, probminhash, quality_rules, toxicity_pu)
from eventloom.llm.frames import read
from eventloom.llm.oracle import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["ORACLE", "QUERIES"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(read(spark, sf_dir, "documents"))


@query
def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents")))


@query
def op3_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_pu.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_packing.pack(read(spark, sf_dir, "documents"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_zstd.digest(license_zstd.scan_licenses(read(spark, sf_dir, "documents")))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_spread.without_boilerplate(read(spark, sf_dir, "documents"), counts=True)
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


@query
def op9_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_in_middle(read(spark, sf_dir, "documents")))


@query
def op12_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_path.align_corpus(read(spark, sf_dir, "documents"))


@query
def op11_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read(spark, sf_dir, "documents"))
