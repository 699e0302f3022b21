"""As-of join: each row with the last row of another table at or before its time.

Both tables are stacked and cut into spans of time. Within a key and span the last
value is carried along by a running window; what a span begins with is the last
value of the spans before it, found among one row a key and span. A key with a
third of all rows is thus many spans, and no task sees more than one span's rows
of a key, or one row for each of its spans.

Of several values at one time the greatest counts (columns in their order). Rows
with a null key or time find nothing, and values with one are found by nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a span, unless asked otherwise.
SPAN = 86_400


def joined(left: DataFrame, right: DataFrame, key: list[str], at: str, span: int = SPAN) -> DataFrame:
    """All rows of ``left`` with the other columns of the last row of ``right`` that has their ``key`` and is not later (``at``, a timestamp in both), or nulls."""
    values = [c for c in right.columns if c not in key and c != at]
    found = right.where(" AND ".join(f"{c} IS NOT NULL" for c in [*key, at])).select(*key, F.col(at).alias("__at"), F.struct(F.col(at).alias("__from"), *values).alias("__value"))
    rows = left.select(*[F.col(c).alias(f"__k{j}") for j, c in enumerate(key)], F.col(at).alias("__at"), F.struct(*left.columns).alias("__row"))
    found = found.select(*[F.col(c).alias(f"__k{j}") for j, c in enumerate(key)], "__at", "__value")
    keys = [f"__k{j}" for j in range(len(key))]
    both = rows.withColumn("__value", F.lit(None).cast(found.schema["__value"].dataType)).unionByName(found.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)))
    both = both.withColumn("__span", F.floor(F.unix_seconds(F.col("__at").cast("timestamp")) / span))
    # Values at a row's own time come before it.
    along = Window.partitionBy(*keys, "__span").orderBy("__at", F.col("__row").isNotNull(), "__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("__last", F.last("__value", ignorenulls=True).over(along))
    # The last value of each span, and for each span that of those before.
    ends = found.withColumn("__span", F.floor(F.unix_seconds(F.col("__at").cast("timestamp")) / span)).groupBy(*keys, "__span").agg(F.max("__value").alias("__end"))
    spans = ends.select(*keys, "__span", "__end").unionByName(rows.where(F.col("__at").isNotNull()).select(*keys, F.floor(F.unix_seconds(F.col("__at").cast("timestamp")) / span).alias("__span")).distinct().withColumn("__end", F.lit(None).cast(found.schema["__value"].dataType)))
    spans = spans.groupBy(*keys, "__span").agg(F.max("__end").alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("__before", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
    out = here.where(F.col("__row").isNotNull()).join(carried, [*keys, "__span"], "left").withColumn("__got", F.coalesce("__last", "__before"))
    named = F.lit(True)
    for k in keys:
        named &= F.col(k).isNotNull()
    return out.select("__row.*", *[F.when(named & F.col("__at").isNotNull(), F.col(f"__got.{c}")).alias(c) for c in values])
