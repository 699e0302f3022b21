"""Differences between two versions of a table, repeats counted.

Rows of both versions are counted together, each different row once with how
often either version has it, so repeats are neither lost nor paired up. Counting
has partial sums, so a row that makes up a third of a table is no hot key.

Nulls are values like others. A row is ``changed`` if its key has rows that went
and rows that came; rows that both versions have as often are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each different row of both (equal columns) with ``n_before`` and ``n_after``."""
    columns = before.columns
    sides = before.select(*columns, F.lit(1).alias("__b"), F.lit(0).alias("__a")).unionByName(after.select(*columns, F.lit(0).alias("__b"), F.lit(1).alias("__a")))
    return sides.groupBy(*columns).agg(F.sum("__b").cast("long").alias("n_before"), F.sum("__a").cast("long").alias("n_after"))


def except_all(before: DataFrame, after: DataFrame) -> DataFrame:
    """Different rows that ``before`` has more often, with how much more (``n``)."""
    return counted(before, after).where("n_before > n_after").withColumn("n", F.col("n_before") - F.col("n_after")).drop("n_before", "n_after")


def intersect_all(before: DataFrame, after: DataFrame) -> DataFrame:
    """Different rows that both have, with how often both do (``n``)."""
    return counted(before, after).where("n_before > 0 AND n_after > 0").withColumn("n", F.least("n_before", "n_after")).drop("n_before", "n_after")


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Different rows with another number in ``after``: the number ``n`` by which it differs, and ``change``: added, gone, or changed_from and changed_to."""
    moved = counted(before, after).where("n_before <> n_after").withColumn("n", F.col("n_after") - F.col("n_before")).drop("n_before", "n_after")
    of_key = Window.partitionBy(*key)
    both = (F.min("n").over(of_key) < 0) & (F.max("n").over(of_key) > 0)
    return moved.withColumn("change", F.when(both, F.when(F.col("n") > 0, "changed_to").otherwise("changed_from")).when(F.col("n") > 0, "added").otherwise("gone"))
