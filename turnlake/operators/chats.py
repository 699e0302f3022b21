"""The second source: times and counts that its messages lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def backfilled(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages without a time of their own get their session's date; ts_source says which (exact, session or null).

    Their hour stays null, as the session's time says nothing about it.
    """
    of = sessions.select("composer_id", F.col("date").alias("__date"))
    rows = messages.join(of, "composer_id", "left")
    source = F.when(F.col("date").isNotNull(), "exact").when(F.col("__date").isNotNull(), "session")
    return rows.withColumn("ts_source", source).withColumn("date", F.coalesce("date", "__date")).drop("__date")


def counted(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds message_count to sessions; 0 for those without messages."""
    n = messages.groupBy("composer_id").agg(F.count(F.lit(1)).alias("message_count"))
    return sessions.join(n, "composer_id", "left").fillna(0, ["message_count"])
