"""All queries by name: callables of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnlake.plans import behaviour, chats, delivery, following, generated, mining, oracles, rollups, temporal, usage  # noqa: F401  (they fill the catalogue)
from turnlake.plans.adapters import Model
from turnlake.plans.catalogue import CATALOGUE


def bound(plan: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Model(spark, sf_dir))


QUERIES = {name: bound(plan) for name, plan in CATALOGUE.items()} | generated.QUERIES | following.QUERIES
ORACLES = oracles.ORACLES | generated.ORACLES | following.ORACLES
