"""Active spans: stretches of a session without a pause longer than a gap.

The same plan works on stored rows and on a stream. A stream needs a watermark on
``ts`` and appends a span once no line can lengthen it any more; the state is the
spans that are still open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """session_id, started, ended, lines, tokens and active_ms of each span of ``rows`` (session_id, ts, tokens); rows without a time are in none."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")) if dict(rows.dtypes)["ts"] != "timestamp" else rows
    found = rows.where("ts IS NOT NULL").groupBy(F.session_window("ts", gap).alias("span"), "session_id")
    found = found.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("lines"), F.sum("tokens").alias("tokens"))
    return found.select("session_id", "started", "ended", "lines", "tokens", F.timestamp_diff("MILLISECOND", F.col("started"), F.col("ended")).alias("active_ms"))
