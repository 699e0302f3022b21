"""A training corpus from raw documents, in five stages.

Each stage takes all rows that its predecessor kept and, but for the last,
returns the columns of ``documents``: rejected, repeated and contaminated
documents are gone, and repeated passages are cut out of the texts of those
that stay (whose n_chars follows). The last adds what the mix takes of each
document and leaves out those of which it takes nothing.

Defined results: null and empty texts pass every filter and are in no mix;
other columns pass through, but those named as one that the mix adds give way to
it; of rows that repeat doc_id and text one stays; empty tables give an empty
result. What each stage does with ties is stated where its operator is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnlake.llm import decontam, line_windows, mixing, near_dedup, toxicity
from turnlake.llm.common import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_windows.clean(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.chosen(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The first stage learns its weights, which SQL can't express; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
