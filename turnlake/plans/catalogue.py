"""The registry of queries: functions of (model, filters) that return DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Plan = Callable[..., DataFrame]
CATALOGUE: dict[str, Plan] = {}

BILLED = "sum(CASE WHEN usage_dupe = 0 THEN 1 ELSE 0 END)"
TOKENS = "sum(input_tokens + output_tokens + cache_write + cache_read)"
#: Costs are rounded as decimals, so that ties fall the same way whatever the order of the sum.
COST = "CAST(round(CAST(sum(cost_usd) AS DECIMAL(28, 10)), 4) AS DOUBLE)"
STAMP = "yyyy-MM-dd HH:mm:ss"


def query(plan: Plan) -> Plan:
    CATALOGUE[plan.__name__] = plan
    return plan


def exprs(**by_name: str) -> list[Column]:
    return [F.expr(e).alias(name) for name, e in by_name.items()]


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first rows by an order that names a key last, so that ties fall the same way each time."""
    return df.orderBy(*order).limit(n)
