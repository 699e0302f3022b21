"""Joins and counts of intervals in time.

Intervals are half open in nothing: both ends belong to them, so two that share
an instant overlap, and an instant is an interval of no length. Times are whole
numbers (milliseconds, say).

:func:`overlaps` joins by equality only. Each interval has a level, the smallest
bin width (a power of two) that it isn't longer than, so at its own level, and at
any wider one, it lies in at most two bins. Of two that overlap the wider one's
level is where they meet: it is there at home, the other comes for a visit. Each
interval thus makes two rows a level that exists, some dozens at most, however
long others are; and rows of one key, even of a third of the table, are dealt out
by bin. A pair that meets in two bins counts in the first.

:func:`concurrency` adds up starts and ends by step, then along the steps of each
span of steps, and adds what was open when the span began: no task sees more than
the steps of one span, or one number for each span of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the narrowest bins, in the unit of the times, and levels at most.
NARROWEST, LEVELS = 1024, 40
#: Steps in a span.
SPAN = 1440


def _level(start: Column, end: Column) -> Column:
    """The level of the narrowest bins that are at least as wide as the interval."""
    widths = F.ceil(F.log2(F.greatest(end - start, F.lit(1)) / F.lit(float(NARROWEST)))).cast("int")
    return F.least(F.greatest(widths, F.lit(0)), F.lit(LEVELS))


def _bin(at: Column, level: Column) -> Column:
    return F.floor(at / (F.lit(float(NARROWEST)) * F.pow(F.lit(2.0), level))).cast("long")


def _placed(rows: DataFrame, key: list[str], levels: DataFrame, side: str) -> DataFrame:
    """The rows' columns as <side>_..., in each bin of each level at which they are at home or visit."""
    at = rows.withColumn("own", _level(F.col("start"), F.col("end"))).join(F.broadcast(levels), F.col("level") >= F.col("own"))
    first, last = _bin(F.col("start"), F.col("level")), _bin(F.col("end"), F.col("level"))
    at = at.withColumns({"first": first, "bin": F.explode(F.sequence(first, last))})
    names = [c for c in rows.columns if c not in key]
    return at.select(*key, "level", "bin", *[F.col(c).alias(f"{side}_{c}") for c in names], (F.col("own") == F.col("level")).alias(f"{side}_home"), F.col("first").alias(f"{side}_first"))


def overlaps(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """All pairs of rows of ``a`` and ``b`` (key, start, end and others) with equal keys that overlap: key, a_... and b_...

    Rows with a null key, start or end, or that end before they start, overlap
    nothing. The levels that exist are some dozens of rows.
    """
    sound = " AND ".join([f"{k} IS NOT NULL" for k in key] + ["start IS NOT NULL", "end IS NOT NULL", "start <= end"])
    a, b = a.where(sound), b.where(sound)
    own = lambda rows: rows.select(_level(F.col("start"), F.col("end")).alias("level"))
    levels = own(a).unionByName(own(b)).distinct()
    met = _placed(a, key, levels, "a").join(_placed(b, key, levels, "b"), [*key, "level", "bin"])
    met = met.where((F.col("a_home") | F.col("b_home")) & (F.col("bin") == F.greatest("a_first", "b_first")) & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")))
    return met.drop("level", "bin", "a_home", "b_home", "a_first", "b_first")


def concurrency(rows: DataFrame, key: list[str], step: int) -> DataFrame:
    """key, step (from ``step`` times the number) and how many intervals of ``rows`` (key, start, end) touch it, at each step at which that number changes."""
    sound = rows.where("start IS NOT NULL AND end IS NOT NULL AND start <= end")
    begun = sound.select(*key, F.floor(F.col("start") / step).alias("step"), F.lit(1).alias("change"))
    ended = sound.select(*key, (F.floor(F.col("end") / step) + 1).alias("step"), F.lit(-1).alias("change"))
    changes = begun.unionByName(ended).groupBy(*key, "step").agg(F.sum("change").alias("change")).withColumn("span", F.floor(F.col("step") / SPAN))
    spans = changes.groupBy(*key, "span").agg(F.sum("change").alias("change"))
    earlier = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    opened = spans.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("span").alias("__span"), F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("before"))
    same = F.col("span") == F.col("__span")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    along = Window.partitionBy(*key, "span").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.join(opened, same).select(*key, "step", (F.col("before") + F.sum("change").over(along)).cast("long").alias("n")).where("n >= 0")
