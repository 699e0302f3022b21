"""Timestamps as sources write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(value: Column) -> Column:
    """A timestamp from a text that holds milliseconds since 1970 or an ISO time; a time without a zone is UTC; null if neither."""
    text = value.cast("string")
    millis = F.timestamp_millis(F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double")).cast("long"))
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.coalesce(millis, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(zoned)))


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
