"""A corpus pipeline over `documents`: quality classifier, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs.  All but the last return the columns of `documents`.

Null texts count as empty and null ids as ids of their own; documents without words, or whose every line repeats,
stay rows with what is left of their text.  Repeated rows are one document to line dedup and near-dedup, which keeps
one of them.  Ties are those of the stages' operators.  Texts of any length are read whole, an empty table gives no
pieces, and further columns, whatever their names, go along until the packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skarn.llm import classifier, decontaminate, lines, minhash, packing
from skarn.llm.session import delete, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier line go."""
    return lines.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences and offsets."""
    return packing.pack(docs, **packing.public_tokenizer())


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("best_fit_packing", packed)]

#: A trained model and a sketch stand in the way of SQL; tests/llm hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; a stage's input goes once it is used."""
    docs = table(spark, sf_dir, "documents")
    at, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        now = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if before:
            delete(spark, before)
        before = now
    return docs
