"""Roll-ups kept up to date load by load, over the generated transcripts.

The lines arrive in three batches: the first turns of most conversations, some
of them in a form that is rewritten later; then the other turns, so that results
of calls, repeated responses and whole sessions come late; then the rewritten
files. What :mod:`turnlake.streaming.refresh` makes of that is compared with SQL
over the conversations.

The ``stream_*`` queries take the same lines as a stream that is up to two days
out of order, in three runs of one query each, through
:mod:`turnlake.streaming.live`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.plans import generated
from turnlake.sources.scratch import cut, new_path
from turnlake.streaming import live, refresh

#: Turns that come with the first batch, and which files (by number of conversation) come late or are rewritten.
FIRST_TURNS, LATE, REWRITTEN = 3, "conv % 4 = 3", "conv % 9 = 5"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated lines as bronze: with batch, and whether a file was read from its start."""
    lines = generated.lines(spark, sf_dir).withColumns({"conv": F.regexp_extract("file", r"(\d+)\.jsonl$", 1).cast("long"), "turn": F.col("byte_offset") % 1_000_000})
    early, rewritten = F.expr(f"turn < {FIRST_TURNS} AND NOT ({LATE})"), F.expr(REWRITTEN)
    batch = F.when(early, 0).otherwise(1)
    columns = ["value", "file", "byte_offset"]
    kept = lines.where(~rewritten).withColumn("batch", batch).select(*columns, ((F.col("batch") == 0) | F.expr(LATE)).alias("restarted"), F.col("batch").cast("long").alias("batch"))
    # What a file says before it is rewritten: other counts, in sessions and days of its own.
    stale = lines.where(rewritten).withColumn("value", F.regexp_replace(F.regexp_replace("value", r'"output_tokens":\d+', '"output_tokens":999'), r'"sessionId":"s', '"sessionId":"old'))
    stale = stale.withColumn("value", F.replace("value", F.lit('"timestamp":"2024-0'), F.lit('"timestamp":"2023-0')))
    stale = stale.select(*columns, F.lit(True).alias("restarted"), F.lit(0).cast("long").alias("batch"))
    again = lines.where(rewritten).select(*columns, F.lit(True).alias("restarted"), F.lit(2).cast("long").alias("batch"))
    return kept.unionByName(stale).unionByName(again)


def followed(spark: SparkSession, sf_dir: str) -> refresh.Store:
    """The store after one load for each batch."""
    bronze, path = cut(arrivals(spark, sf_dir), "bronze"), new_path(spark, "followed")
    for upto in range(3):
        refresh.refresh(spark, "/generated", bronze.where(F.col("batch") <= upto), path)
    return refresh.Store(spark, path)


def incremental_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followed(spark, sf_dir).table("daily")


def incremental_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followed(spark, sf_dir).table("session_facts").select("session_id", "project", "started", "ended", "api_calls", "total_tokens", "cost_usd", "tool_uses", "tool_calls", "tool_errors", "prompts", "prompt_records")


#: Runs of a streaming query, and hours that lines come late at most.
RUNS, HOURS = 3, 48


def streamed(spark: SparkSession, sf_dir: str, changes_of: Callable[..., DataFrame]) -> DataFrame:
    """Changes that a streaming query writes while the generated lines arrive in RUNS parts, by time and a delay."""
    lines = generated.lines(spark, sf_dir)
    ts = F.unix_seconds(F.to_timestamp(F.regexp_extract("value", r'"timestamp":"([^"]+)"', 1)))
    arrival = ts + F.pmod(F.xxhash64("value"), F.lit(HOURS * 3600))
    rows = cut(lines.withColumn("arrival", arrival), "arriving")
    first, last = rows.agg(F.min("arrival"), F.max("arrival")).first()
    inbox, out, marks = (new_path(spark, x) for x in ("inbox", "changes", "marks"))
    own, changes = live.session(spark), None
    for run in range(RUNS):
        part = F.floor((F.col("arrival") - F.lit(first)) * RUNS / F.lit((last or 0) - (first or 0) + 1)) == run if first is not None else F.lit(True)
        rows.where(part).drop("arrival").write.mode("append").parquet(inbox)
        changes = changes_of(own.readStream.schema("value string, file string, byte_offset long").parquet(inbox))
        live.start(changes, out, marks).awaitTermination()
    return spark.read.schema(changes.schema).parquet(out)


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.usage(streamed(spark, sf_dir, live.usage_changes), "date")


def stream_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.calls(streamed(spark, sf_dir, live.call_changes), "date", "name")


QUERIES = {f.__name__: f for f in (incremental_daily, incremental_sessions, stream_usage, stream_tools)}

_MESSAGES = """, m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY uuid) > 1 THEN 1 ELSE 0 END AS usage_dupe FROM c WHERE role = 'assistant'),
u AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date, coalesce(named, m.folder) AS project, CASE WHEN usage_dupe = 0 THEN conv_id % 100 + again ELSE 0 END AS i, CASE WHEN usage_dupe = 0 THEN turn * 10 ELSE 0 END AS o,
  CASE WHEN usage_dupe = 0 AND conv_id % 2 = 0 THEN 7 ELSE 0 END AS r, CASE WHEN turn % 2 = 1 THEN 1 ELSE 0 END AS tool_uses FROM m JOIN s USING (session_id)),
p AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date FROM c WHERE role <> 'assistant' AND NOT (role = 'user' AND turn % 2 = 0 AND turn > 0)),
t AS (SELECT a.session_id, CASE WHEN x.conv_id % 4 = 1 THEN 1 ELSE 0 END AS is_error FROM c a LEFT JOIN c x ON x.conv_id = a.conv_id AND x.turn = a.turn + 1 AND x.role = 'user' WHERE a.role = 'assistant' AND a.turn % 2 = 1)
"""
_COST = "CAST(round(CAST(sum((i + r * 0.1) * 3.0 / 1000000.0 + o * 15.0 / 1000000.0) AS DECIMAL(28, 10)), 4) AS DOUBLE)"
_SUMS = f"CAST(sum(1 - usage_dupe) AS BIGINT) AS api_calls, CAST(sum(i + o + r) AS BIGINT) AS total_tokens, {_COST} AS cost_usd, CAST(sum(tool_uses) AS BIGINT) AS tool_uses"
ORACLES = {
    "incremental_daily": generated.ROWS + _MESSAGES + f"""SELECT date, {_SUMS}, count(DISTINCT session_id) AS sessions, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_write, CAST(sum(r) AS BIGINT) AS cache_read,
  CAST(0 AS BIGINT) AS thinking_blocks, coalesce(any_value(n), 0) AS prompts, CAST(0 AS BIGINT) AS injected_prompts FROM u LEFT JOIN (SELECT date, count(*) AS n FROM p GROUP BY date) USING (date) GROUP BY date""",
    "incremental_sessions": generated.ROWS + _MESSAGES + f"""SELECT session_id, any_value(project) AS project, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, {_SUMS},
  coalesce(any_value(n_tools), 0) AS tool_calls, CAST(coalesce(any_value(n_errors), 0) AS BIGINT) AS tool_errors, coalesce(any_value(n_prompts), 0) AS prompts, coalesce(any_value(n_prompts), 0) AS prompt_records
FROM u LEFT JOIN (SELECT session_id, count(*) AS n_tools, sum(is_error) AS n_errors FROM t GROUP BY 1) USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n_prompts FROM p GROUP BY 1) USING (session_id) GROUP BY session_id""",
    "stream_usage": generated.ROWS + _MESSAGES + f"""SELECT date, {_SUMS}, count(DISTINCT session_id) AS sessions, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_write, CAST(sum(r) AS BIGINT) AS cache_read
FROM u GROUP BY date""",
    "stream_tools": generated.ROWS + """SELECT strftime(a.ts, '%Y-%m-%d') AS date, ['Edit', 'Bash', 'mcp__docs__find'][a.conv_id % 3 + 1] AS name, count(*) AS calls, count(x.turn) AS completed, CAST(sum(CASE WHEN x.conv_id % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(0 AS BIGINT) AS interrupted, 2 * count(x.turn) AS lines_added, count(x.turn) AS lines_removed, 120000 * count(x.turn) AS latency_ms
FROM c a LEFT JOIN c x ON x.conv_id = a.conv_id AND x.turn = a.turn + 1 AND x.role = 'user' WHERE a.role = 'assistant' AND a.turn % 2 = 1 GROUP BY 1, 2""",
}
