"""From raw documents to packed training sequences.

Five stages, each over all that its predecessor kept: documents that the quality classifier rejects go, one
document of each group of near duplicates stays (five-word shingles, similarity 0.8), documents that hold a
benchmark window go, live-looking credentials are cut out of the texts, and what is left is packed. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapeminer.llm.common import release, table, written
from shapeminer.llm.decontaminate import clean
from shapeminer.llm.neardup import deduplicated
from shapeminer.llm.packing import pack_documents
from shapeminer.llm.quality import accepted
from shapeminer.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, shingle=5, least=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]

#: A trained classifier, tokenizer ids and bin packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        older, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            release(older)
    return STAGES[-1][1](spark, docs, sf_dir)
