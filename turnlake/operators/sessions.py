"""Sessions: one row from many records, project labels, and the wide fact row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import paths

NESTED = "(transcript <> 'main' OR is_sidechain = 1)"


def _cents(x: Column) -> Column:
    """Rounded to four places as a decimal, so that ties fall the same way whatever the order of a sum."""
    return F.round(x.cast("decimal(28, 10)"), 4).cast("double")


def title() -> Column:
    """A session's name for people; the caller has session_id beside the session's columns."""
    return F.coalesce("custom_title", "ai_title", "agent_name", "session_id")


def folded(records: DataFrame) -> DataFrame:
    """One row for each session of ``records`` (session_id, at, ts and what a record says of its session).

    ``at`` orders records. The first value that isn't empty stands for slug,
    branch, version, entrypoint and folder; titles and agent names are the last.
    """
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("at"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("at"))).alias(c)
    return records.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        *[first(c) for c in ("slug", "git_branch", "version", "entrypoint", "cwd", "project_dir")], *[last(c) for c in ("ai_title", "custom_title", "agent_name")], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).withColumn("project", paths.project_of(F.col("cwd"), F.col("project_dir")))


def relabelled(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """``rows`` with the project that their session's folder names; rows of other sessions keep theirs."""
    named = F.element_at(F.split(F.rtrim(F.replace(F.col("cwd"), F.lit("\\"), F.lit("/")), F.lit("/")), "/"), -1)
    of = sessions.select("session_id", F.nullif(named, F.lit("")).alias("__project"))
    return rows.join(of, "session_id", "left").withColumn("project", F.coalesce("__project", "project")).drop("__project")


def facts(messages: DataFrame, sessions: DataFrame, tools: DataFrame, prompts: DataFrame, turns: DataFrame, events: DataFrame) -> DataFrame:
    """One wide row for each session that has responses.

    Each table is summed up by session before the joins, so they meet one row a
    session each; sessions are as many as there are of them and are shuffled,
    not broadcast.
    """
    when = lambda cond, value: F.sum(F.expr(f"CASE WHEN {cond} THEN {value} ELSE 0 END"))
    m = messages.groupBy("session_id").agg(
        F.max_by("project", F.struct("ts", "uuid")).alias("project"), F.min("ts").alias("started"), F.max("ts").alias("ended"), when("usage_dupe = 0", "1").alias("api_calls"),
        F.sum(F.expr("input_tokens + output_tokens + cache_write + cache_read")).alias("total_tokens"), F.sum("cache_read").alias("cache_read"), F.sum(F.expr("input_tokens + cache_write")).alias("billed_in"),
        _cents(F.sum("cost_usd")).alias("cost_usd"), F.sum("tool_uses").alias("tool_uses"), when(NESTED, "cost_usd").alias("nested_cost"), when(NESTED, "tool_uses").alias("nested_tools"),
        F.max(F.expr("CASE WHEN model ILIKE 'claude-opus%' THEN 1 ELSE 0 END")).alias("uses_opus"), F.count_distinct(F.expr("CASE WHEN model <> '<synthetic>' THEN model END")).alias("distinct_models"),
        F.count("error_kind").alias("error_replies"),
    )
    s = sessions.select("session_id", "custom_title", "ai_title", "agent_name", "entrypoint", "cwd")
    readonly = ", ".join(f"'{t}'" for t in paths.READONLY_TOOLS)
    t = tools.groupBy("session_id").agg(F.count(F.lit(1)).alias("tool_calls"), when(f"name IN ({readonly})", "1").alias("readonly_calls"), when("name = 'Agent'", "1").alias("agent_calls"), F.sum("is_error").alias("tool_errors"))
    p = prompts.groupBy("session_id").agg(
        when("is_human = 1", "1").alias("prompts"), F.count(F.lit(1)).alias("prompt_records"), when("is_human = 1 AND array_contains(intents, 'correction')", "1").alias("corrections"), when("is_slash = 1", "1").alias("slash")
    )
    u = turns.groupBy("session_id").agg(F.sum("duration_ms").alias("turn_ms"), F.count(F.lit(1)).alias("turns"))
    e = events.groupBy("session_id").agg(when("kind = 'interrupt'", "1").alias("interrupts"), when("kind = 'compact'", "1").alias("compactions"))
    rows = m.join(s, "session_id", "left")
    for other in (t, p, u, e):
        rows = rows.join(other, "session_id", "left")
    counts = ["tool_calls", "readonly_calls", "agent_calls", "tool_errors", "prompts", "prompt_records", "corrections", "slash", "turn_ms", "turns", "interrupts", "compactions"]
    rows = rows.fillna(0, counts)
    c = F.col
    return rows.withColumn("title", title()).withColumn("wall_ms", F.timestamp_diff("MILLISECOND", c("started"), c("ended"))).withColumns(
        {
            "headless": F.when(F.coalesce("entrypoint", F.lit("")).isin("cli", ""), 0).otherwise(1),
            "readonly_share": F.when(c("tool_calls") > 0, F.round(c("readonly_calls") / F.nullif("tool_calls", F.lit(0)), 2)).otherwise(F.lit(0.0)),
            "cost_per_tool": F.when(c("tool_calls") > 0, _cents(c("cost_usd") / F.nullif("tool_calls", F.lit(0)))),
            "parallelism": F.when((c("wall_ms") > 0) & (c("turn_ms") > 0), F.round(c("turn_ms") / F.nullif("wall_ms", F.lit(0)), 2)),
            "cache_hit": F.coalesce(F.round(c("cache_read") / F.nullif(c("cache_read") + c("billed_in"), F.lit(0)) * 100, 1), F.lit(0.0)),
        }
    ).drop("custom_title", "ai_title", "agent_name")
