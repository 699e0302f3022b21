"""What happens at the same time, and what held at a time: interval and as-of joins over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.filters import EVERYTHING, Filters
from turnlake.functions import pricing
from turnlake.operators import asof, intervals
from turnlake.plans.catalogue import COST, exprs, query

MINUTE = 60_000


def _spans(m, f: Filters) -> DataFrame:
    """Turns as intervals in milliseconds; a turn is logged at its end."""
    end = F.unix_millis("ts")
    return f.apply(m.turns).select("project", "uuid", (end - F.col("duration_ms")).alias("start"), end.alias("end"))


@query
def overlapping_turns(m, f: Filters = EVERYTHING) -> DataFrame:
    """Pairs of turns of one project that ran at the same time, and how long they did."""
    turns = _spans(m, f)
    pairs = intervals.overlaps(turns, turns, ["project"]).where("a_uuid < b_uuid")
    return pairs.groupBy("project").agg(*exprs(pairs="count(1)", together_ms="CAST(sum(least(a_end, b_end) - greatest(a_start, b_start)) AS BIGINT)"))


@query
def busy_minutes(m, f: Filters = EVERYTHING) -> DataFrame:
    """By project: at how many minutes the number of running turns changes, and the most that run in one."""
    steps = intervals.concurrency(_spans(m, f), ["project"], MINUTE)
    return steps.groupBy("project").agg(*exprs(changes="count(1)", most="max(n)"))


@query
def last_interrupts(m, f: Filters = EVERYTHING) -> DataFrame:
    """For each response line, the last time before it that its session was interrupted."""
    stops = f.apply(m.events).where("kind = 'interrupt'").select("session_id", "ts", F.col("uuid").alias("interrupt"))
    return asof.joined(f.apply(m.messages).select("session_id", "ts", "uuid"), stops, ["session_id"], "ts").select("uuid", "interrupt")


def priced_as_of(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """``lines`` with cost_usd at the rates (model, ts, price_in, price_out) that held at their time; before the first, and for other models, the default ones."""
    found = asof.joined(lines.drop("cost_usd"), rates, ["model"], "ts")
    price = [F.coalesce(c, F.lit(default)) for c, default in zip(("price_in", "price_out"), pricing.DEFAULT)]
    writes = pricing.five_minute_writes(F.col("cache_write"), F.col("eph_5m"), F.col("eph_1h"))
    return found.withColumn("cost_usd", pricing.cost(*price, F.col("input_tokens"), F.col("output_tokens"), writes, F.col("eph_1h"), F.col("cache_read"))).drop("price_in", "price_out")


@query
def costs_as_of(m, f: Filters = EVERYTHING) -> DataFrame:
    """Costs by model where rates change in time, as the sample's table of rates says."""
    return priced_as_of(f.apply(m.messages), m.rates).groupBy("model").agg(*exprs(lines="count(1)", cost_usd=COST))
