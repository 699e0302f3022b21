"""Typed tables of transcripts, written once and read by every query.

Tables over raw lines parse them anew for each query. :func:`write` parses them
once, to records by type, and each table once from the records of its types;
those with days are laid out by date, so that the filters of queries leave out
files. Usage that is counted once and project labels are worked out before, as
they depend on lines of other days.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators import git
from turnlake.sources.transcripts import Transcripts

#: Tables with a date, and those without; where the files for history and the roll-up cache are missing, their tables are, too.
DATED = ("messages", "tools", "prompts", "events", "turns", "subagents", "git")
PLAIN = ("sessions", "folders")
BESIDE = ("history", "legacy_days", "legacy_models", "legacy_meta")


class Stored:
    """Model tables under a path that :func:`write` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DATED + PLAIN + BESIDE:
            raise AttributeError(name)
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return rows.withColumn("date", F.col("date").cast("string")) if name in DATED else rows

    @cached_property
    def tickets(self) -> DataFrame:
        return git.ticket_evidence(self)


def write(model: Transcripts, path: str, mode: str = "overwrite", beside: bool = True) -> Stored:
    """Writes all tables of ``model``; without ``beside`` none of history and the roll-up cache."""
    spark = model.spark
    model.records.write.mode(mode).partitionBy("type").parquet(f"{path}/records")
    parsed = Transcripts(spark, model.home, model._lines, spark.read.parquet(f"{path}/records"))
    for name in DATED:
        # Days are gathered before they are written, or every task would write a file for each.
        getattr(parsed, name).repartition("date", F.pmod(F.xxhash64("session_id"), F.lit(8))).write.mode(mode).partitionBy("date").parquet(f"{path}/{name}")
    for name in PLAIN + (BESIDE if beside else ()):
        getattr(parsed, name).write.mode(mode).parquet(f"{path}/{name}")
    return Stored(spark, path)
