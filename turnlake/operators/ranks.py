"""Exact medians of groups of any size.

The built-in median keeps every different value of a group in one object. Here
values are counted first, each value of a group once; counts are added up by
coarse steps of value, which tells the step that holds the median and how many
values are before it; then only that step's values are walked in order. Groups
and values are shuffled with partial sums; a task sees the steps of one group,
some thousands, or the values of one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps to a doubling of the value.
FINE = 64


def _step(value: Column) -> Column:
    """A whole number that doesn't fall as the value grows, with about FINE values to a doubling on either side of zero."""
    size = F.floor(F.log2(F.abs(value).cast("double") + 1) * FINE).cast("int")
    return F.when(value < 0, -size).otherwise(size)


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and the median of ``value`` (a number), of an even number of values the mean of the two in the middle; groups without values, and null values, are left out (but without ``by`` there is one row, null if there is no value)."""
    known = rows.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__step", _step(F.col("__value")))
    steps = counts.groupBy(*by, "__step").agg(F.sum("__n").alias("__n"))
    group = Window.partitionBy(*by)
    upto = F.sum("__n").over(group.orderBy("__step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = steps.withColumns({"__upto": upto, "__all": F.sum("__n").over(group)})
    # Ranks from 0 of the two values in the middle, which may be one.
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    before = F.col("__upto") - F.col("__n")
    held = steps.where((before <= high) & (F.col("__upto") > low)).select(*[F.col(c).alias(f"__by{j}") for j, c in enumerate(by)], F.col("__step").alias("__at"), before.alias("__before"), "__all")
    same = F.col("__step") == F.col("__at")
    for j, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{j}"))
    inside = F.sum("__n").over(Window.partitionBy(*by, "__step").orderBy("__value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.join(held, same).withColumn("__last", F.col("__before") + inside)
    middle = placed.where((F.col("__last") - F.col("__n") <= high) & (F.col("__last") > low))
    return middle.groupBy(*by).agg(((F.min("__value") + F.max("__value")) / 2).cast("double").alias("median"))
