"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.llm.classifier import quality_classifier
from skarn.llm.decontaminate import benchmark_hits
from skarn.llm.rules import quality_rules
from skarn.llm import bpe, clusters, divergence, extract, lines, minhash, packing, sharding, substrings, units
from skarn.llm.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


ORACLES["op1_sharding"] = sharding.ORACLE
ORACLES["op3_substring_dedup"] = units.ORACLE
ORACLES["op4_minhash_near_dedup"] = minhash.ORACLE
ORACLES["op5_line_dedup"] = lines.ORACLE
ORACLES["op11_source_divergence"] = divergence.ORACLE
ORACLES["op12_centroid_clustering"] = clusters.ORACLE


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding(table(spark, sf_dir, "documents"))


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.unit_dedup(table(spark, sf_dir, "documents"))


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"))


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(table(spark, sf_dir, "pages"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **packing.public_tokenizer())


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.public_ranks()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
