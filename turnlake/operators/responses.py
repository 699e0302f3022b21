"""Model responses: count each billed one once, and price its tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import pricing

#: What a repeated line of a response must not be counted for again.
USAGE = ("input_tokens", "output_tokens", "cache_write", "cache_read", "eph_5m", "eph_1h", "web_search_reqs", "web_fetch_reqs")


def billed_once(lines: DataFrame) -> DataFrame:
    """Flags repeated lines of a response (usage_dupe) and zeroes their usage.

    Lines with one message_id, or without it one request_id, are one response;
    its line with the smallest uuid keeps the usage. Lines with neither are all
    kept, under keys of their own so that they don't meet in one task.
    """
    key = F.coalesce("message_id", "request_id")
    response = F.when(key.isNotNull(), F.concat(F.lit("k"), key)).otherwise(F.concat(F.lit("u"), F.coalesce("uuid", F.lit("")), F.lit("|"), F.xxhash64("session_id", "ts").cast("string")))
    first = F.row_number().over(Window.partitionBy("__response").orderBy("uuid"))
    rows = lines.withColumn("__response", response).withColumn("usage_dupe", F.when(key.isNotNull() & (first > 1), 1).otherwise(0))
    return rows.withColumns({c: F.when(F.col("usage_dupe") == 0, F.col(c)).otherwise(F.lit(0)).alias(c) for c in USAGE if c in lines.columns}).drop("__response")


def priced(lines: DataFrame) -> DataFrame:
    """Adds cost_usd by the rates of each line's model."""
    writes = pricing.five_minute_writes(F.col("cache_write"), F.col("eph_5m"), F.col("eph_1h"))
    cost = pricing.cost(F.col("price_in"), F.col("price_out"), F.col("input_tokens"), F.col("output_tokens"), writes, F.col("eph_1h"), F.col("cache_read"))
    return pricing.with_rates(lines).withColumn("cost_usd", cost).drop("price_in", "price_out", "price_confidence")
