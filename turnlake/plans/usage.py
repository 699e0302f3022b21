"""Usage: totals, days, models, projects, tools, sessions, prompts, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.filters import EVERYTHING, Filters
from turnlake.functions import pricing
from turnlake.operators import ranks
from turnlake.operators import sessions as session_rows
from turnlake.plans.catalogue import BILLED, COST, STAMP, TOKENS, exprs, query, top


@query
def usage_dedupe(m, f: Filters = EVERYTHING) -> DataFrame:
    """Every line with its usage as it counts."""
    return f.apply(m.messages).select("uuid", "usage_dupe", "input_tokens", "output_tokens", "cache_write", "cache_read", "web_search_reqs", F.round("cost_usd", 8).alias("cost_usd"))


@query
def row_cost(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.messages).groupBy("model").agg(*exprs(lines="count(1)", cost_usd="round(sum(cost_usd), 6)"))


@query
def overview_messages(m, f: Filters = EVERYTHING) -> DataFrame:
    sums = ("input_tokens", "output_tokens", "cache_write", "cache_read", "thinking_blocks", "thinking_chars", "text_chars", "tool_uses")
    named = {"api_errors": "is_api_error", "web_searches": "web_search_reqs", "web_fetches": "web_fetch_reqs"} | {c: c for c in sums}
    return f.apply(m.messages).agg(
        *exprs(assistant_blocks="count(1)", assistant_messages=BILLED, sessions="count(DISTINCT session_id)", projects="count(DISTINCT project)", active_days="count(DISTINCT date)"),
        *exprs(cost_usd="round(coalesce(sum(cost_usd), 0), 6)", first_day="min(date)", last_day="max(date)", **{k: f"coalesce(sum({c}), 0)" for k, c in named.items()}),
    )


@query
def overview_tools(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.tools).agg(
        *exprs(
            tool_calls="count(1)", tool_errors="coalesce(sum(is_error), 0)", interrupted="coalesce(sum(interrupted), 0)", lines_added="coalesce(sum(lines_added), 0)", lines_removed="coalesce(sum(lines_removed), 0)",
            files_touched="count(DISTINCT file_path)", denials="count(denial_kind)", mcp_calls="sum(is_mcp)", web_search_calls="count_if(name = 'WebSearch')", web_fetch_calls="count_if(name = 'WebFetch')",
        )
    )


@query
def overview_prompts(m, f: Filters = EVERYTHING) -> DataFrame:
    human = "CASE WHEN is_human = 1 THEN {} END"
    return f.apply(m.prompts).agg(
        *exprs(
            prompt_records="count(1)", prompts="count_if(is_human = 1)", prompt_chars=f"coalesce(sum({human.format('chars')}), 0)",
            avg_prompt_chars=f"round(coalesce(avg({human.format('chars')}), 0), 6)", prompt_words=f"coalesce(sum({human.format('words')}), 0)",
        )
    )


@query
def overview_turns(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.turns).agg(*exprs(turns="count(1)", total_turn_ms="coalesce(sum(duration_ms), 0)", avg_turn_ms="round(coalesce(avg(duration_ms), 0), 4)", max_turn_ms="coalesce(max(duration_ms), 0)"))


@query
def overview_derived(m, f: Filters = EVERYTHING) -> DataFrame:
    """Rates and averages over the totals; both sides are one row."""
    totals = f.apply(m.messages).agg(
        *exprs(total_tokens=TOKENS, reads="sum(cache_read)", paid="sum(input_tokens + cache_write)", cost="sum(cost_usd)", days="count(DISTINCT date)", sidechain_messages="count_if(is_sidechain = 1)")
    )
    calls = f.apply(m.tools).agg(*exprs(calls="count(1)", errors="sum(is_error)"))
    return totals.join(calls, F.lit(True)).select(
        "total_tokens", "sidechain_messages",
        *exprs(
            cache_hit_pct="coalesce(round(reads / nullif(reads + paid, 0) * 100, 1), 0)", tool_error_rate="coalesce(round(errors / nullif(calls, 0) * 100, 1), 0)",
            avg_cost_per_active_day="round(cost / nullif(days, 0), 2)", avg_tokens_per_active_day="CAST(floor(total_tokens / nullif(days, 0)) AS BIGINT)",
        ),
    )


@query
def filtered_overview(m, f: Filters = Filters("2024-01-05", "2024-01-20", "p3")) -> DataFrame:
    """The totals under a filter of days and project."""
    return overview_messages(m, f)


@query
def daily(m, f: Filters = EVERYTHING) -> DataFrame:
    """Per day with responses: what models did, and how many prompts people typed or programs sent."""
    days = f.apply(m.messages).where("date IS NOT NULL").groupBy("date").agg(
        *exprs(
            api_calls=BILLED, sessions="count(DISTINCT session_id)", input_tokens="sum(input_tokens)", output_tokens="sum(output_tokens)", cache_write="sum(cache_write)", cache_read="sum(cache_read)",
            total_tokens=TOKENS, cost_usd=COST, tool_uses="sum(tool_uses)", thinking_blocks="sum(thinking_blocks)",
        )
    )
    typed = f.apply(m.prompts).groupBy("date").agg(*exprs(prompts="count_if(is_human = 1)", injected_prompts="count_if(is_human = 0)"))
    return days.join(typed, "date", "left").fillna(0, ["prompts", "injected_prompts"])


@query
def calendar(m, f: Filters = EVERYTHING) -> DataFrame:
    """Every day from the first to the last, with 0 where nothing happened."""
    days = f.apply(m.messages).where("date IS NOT NULL").groupBy("date").agg(*exprs(api_calls=BILLED))
    span = days.agg(F.min("date").cast("date").alias("a"), F.max("date").cast("date").alias("b")).where("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", "b")).alias("d")).select(F.col("d").cast("string").alias("date"))
    return every.join(days, "date", "left").fillna(0, ["api_calls"])


@query
def hourly(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.messages).where("hour IS NOT NULL").groupBy("hour").agg(*exprs(api_calls=BILLED, tokens=TOKENS, cost_usd=COST))


@query
def punchcard(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.messages).where("hour IS NOT NULL AND dow IS NOT NULL").groupBy("dow", "hour").agg(*exprs(api_calls=BILLED, tokens=TOKENS))


@query
def models(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.messages).where("model IS NOT NULL").groupBy("model").agg(
        *exprs(
            messages=BILLED, sessions="count(DISTINCT session_id)", input_tokens="sum(input_tokens)", output_tokens="sum(output_tokens)", cache_write="sum(cache_write)", cache_read="sum(cache_read)",
            total_tokens=TOKENS, cost_usd=COST, thinking_blocks="sum(thinking_blocks)", avg_output_tokens=f"round(sum(output_tokens) / nullif({BILLED}, 0), 1)",
        )
    )
    return pricing.with_rates(rows)


@query
def projects(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.messages).where("project IS NOT NULL").groupBy("project").agg(
        *exprs(
            messages=BILLED, sessions="count(DISTINCT session_id)", active_days="count(DISTINCT date)", total_tokens=TOKENS, output_tokens="sum(output_tokens)", cost_usd=COST, tool_uses="sum(tool_uses)",
            first_day="min(date)", last_day="max(date)",
        )
    )
    edits = f.apply(m.tools).groupBy("project").agg(*exprs(lines_added="sum(lines_added)", lines_removed="sum(lines_removed)", files_touched="count(DISTINCT file_path)", tool_calls="count(1)"))
    turns = f.apply(m.turns).groupBy("project").agg(*exprs(turn_ms="sum(duration_ms)"))
    return rows.join(edits, "project", "left").join(turns, "project", "left").fillna(0, ["lines_added", "lines_removed", "files_touched", "tool_calls", "turn_ms"])


@query
def project_list(m, f: Filters = EVERYTHING) -> DataFrame:
    return m.messages.where("project IS NOT NULL").select("project").distinct().orderBy("project")


@query
def project_relabel(m, f: Filters = EVERYTHING) -> DataFrame:
    """How many tool calls each project has once sessions' folders name it."""
    return session_rows.relabelled(m.tools.withColumn("project", F.lit("old")), m.sessions).groupBy("project").agg(*exprs(calls="count(1)"))


@query
def tools(m, f: Filters = EVERYTHING) -> DataFrame:
    """Per tool; waiting for a person skews the mean latency, hence the median beside it."""
    rows = f.apply(m.tools)
    whole = rows.groupBy("name").agg(
        *exprs(
            calls="count(1)", errors="sum(is_error)", interrupted="sum(interrupted)", denied="count(denial_kind)", completed="sum(has_result)", avg_latency_ms="round(avg(latency_ms), 0)", max_latency_ms="max(latency_ms)",
            avg_result_chars="round(avg(result_chars), 0)", total_result_chars="sum(result_chars)", lines_added="sum(lines_added)", lines_removed="sum(lines_removed)", is_mcp="max(is_mcp)", mcp_server="max(mcp_server)",
        )
    )
    middle = ranks.medians(rows, ["name"], "latency_ms").select(F.col("name").alias("of"), F.round("median", 0).alias("median_latency_ms"))
    return whole.join(middle, F.col("name").eqNullSafe(F.col("of")), "left").drop("of")


@query
def tool_median_latency(m, f: Filters = EVERYTHING) -> DataFrame:
    return ranks.medians(f.apply(m.tools), ["name"], "latency_ms").select("name", F.round("median", 0).alias("median_latency_ms"))


@query
def tool_daily(m, f: Filters = EVERYTHING) -> DataFrame:
    """Calls by day of the eight most used tools."""
    calls = f.apply(m.tools)
    most = top(calls.groupBy("name").agg(*exprs(c="count(1)")), 8, F.desc("c"), F.asc("name"))
    return calls.where("date IS NOT NULL").join(F.broadcast(most.select("name")), "name", "left_semi").groupBy("date", "name").agg(*exprs(calls="count(1)"))


@query
def failing_tools(m, f: Filters = EVERYTHING) -> DataFrame:
    """Tools with at least 20 calls of which more than 5 % fail."""
    rows = f.apply(m.tools).groupBy("name").agg(*exprs(calls="count(1)", errors="sum(is_error)"))
    return rows.where("calls >= 20 AND errors * 100 > 5 * calls").withColumn("error_pct", F.round(F.col("errors") / F.col("calls") * 100, 1))


@query
def denials_by_kind(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.tools).where("denial_kind IS NOT NULL").groupBy("denial_kind").agg(*exprs(n="count(1)"))


@query
def denials_by_tool(m, f: Filters = EVERYTHING) -> DataFrame:
    return top(f.apply(m.tools).where("denial_kind IS NOT NULL").groupBy("name", "denial_kind").agg(*exprs(n="count(1)")), 25, F.desc("n"), F.asc("name"), F.asc("denial_kind"))


@query
def top_files(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.tools).where("file_path IS NOT NULL").groupBy("file_path").agg(
        *exprs(
            file_ext="max(file_ext)", touches="count(1)", lines_added="sum(lines_added)", lines_removed="sum(lines_removed)", sessions="count(DISTINCT session_id)",
            writes="count_if(name IN ('Edit', 'Write', 'NotebookEdit'))", reads="count_if(name = 'Read')",
        )
    )
    return top(rows, 40, F.desc("touches"), F.asc("file_path"))


@query
def files_by_ext(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.tools).where("file_ext IS NOT NULL").groupBy("file_ext").agg(*exprs(touches="count(1)", files="count(DISTINCT file_path)", lines_added="sum(lines_added)", lines_removed="sum(lines_removed)"))
    return top(rows, 25, F.desc("touches"), F.asc("file_ext"))


@query
def bash_programs(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.tools).where("bash_program IS NOT NULL").groupBy(F.col("bash_program").alias("program"))
    return top(rows.agg(*exprs(calls="count(1)", errors="sum(is_error)", interrupted="sum(interrupted)", avg_latency_ms="round(avg(latency_ms), 0)")), 30, F.desc("calls"), F.asc("program"))


@query
def sessions(m, f: Filters = EVERYTHING) -> DataFrame:
    """The sixty sessions with most tokens."""
    rows = f.apply(m.messages).groupBy("session_id").agg(
        F.max_by("project", F.struct("ts", "uuid")).alias("project"),
        *exprs(started=f"date_format(min(ts), '{STAMP}')", ended=f"date_format(max(ts), '{STAMP}')", messages=BILLED, total_tokens=TOKENS, cost_usd=COST, tool_uses="sum(tool_uses)", sidechain_messages="sum(is_sidechain)"),
    )
    # Only what the report shows meets the sessions' own rows.
    most = top(rows, 60, F.desc("total_tokens"), F.asc("session_id"))
    return most.join(m.sessions.drop("project", "first_ts", "last_ts"), "session_id", "left").withColumn("title", session_rows.title()).drop("custom_title", "ai_title", "agent_name", "entrypoint")


@query
def session_shape(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.messages).groupBy("session_id").agg(*exprs(messages=BILLED, total_tokens=TOKENS, cost_usd=COST))


#: Least and most messages of each bucket of the histogram.
SIZES = ((1, 1), (2, 4), (5, 9), (10, 24), (25, 49), (50, 99), (100, 249), (250, 499), (500, None))


@query
def session_histogram(m, f: Filters = EVERYTHING) -> DataFrame:
    """Sessions by their number of messages; those without any are in no bucket."""
    bucket = F.lit(None).cast("string")
    for low, high in reversed(SIZES):
        name = f"{low}+" if high is None else str(low) if low == high else f"{low}-{high}"
        inside = F.col("messages") >= low if high is None else F.col("messages").between(low, high)
        bucket = F.when(inside, name).otherwise(bucket)
    return session_shape(m, f).withColumn("bucket", bucket).where("bucket IS NOT NULL").groupBy("bucket").agg(*exprs(sessions="count(1)"))


@query
def prompts_by_source(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.prompts).groupBy("source", "is_human").agg(*exprs(n="count(1)", avg_chars="round(avg(chars), 0)"))
    return rows.select(*exprs(source="coalesce(source, '(unlabelled)')", who="CASE WHEN is_human = 1 THEN 'you' ELSE 'automated' END"), "n", "avg_chars")


@query
def prompts_by_origin(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.prompts).groupBy(F.expr("coalesce(origin_kind, '(none)')").alias("origin")).agg(*exprs(n="count(1)"))


@query
def prompts_daily(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.prompts).where("date IS NOT NULL AND is_human = 1").groupBy("date").agg(*exprs(prompts="count(1)", avg_chars="round(avg(chars), 0)"))


@query
def prompts_longest(m, f: Filters = EVERYTHING) -> DataFrame:
    return top(f.apply(m.prompts).where("is_human = 1"), 10, F.desc("chars"), F.asc("uuid")).select("uuid", "date", "project", "chars", "words", "preview")


@query
def versions(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.messages).where("version IS NOT NULL").groupBy("version").agg(*exprs(messages="count(1)", first_day="min(date)", last_day="max(date)"))
    return top(rows, 30, F.desc("first_day"), F.asc("version"))


@query
def branches(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.messages).where("git_branch IS NOT NULL").groupBy("git_branch").agg(*exprs(messages="count(1)", sessions="count(DISTINCT session_id)"))
    return top(rows, 20, F.desc("messages"), F.asc("git_branch"))


@query
def skills_used(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.messages).where("skill IS NOT NULL").groupBy("skill").agg(*exprs(messages="count(1)", tokens=TOKENS, cost_usd=COST))


@query
def mcp_servers(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.tools).where("is_mcp = 1").groupBy("mcp_server").agg(*exprs(calls="count(1)", distinct_tools="count(DISTINCT name)", errors="sum(is_error)"))


@query
def subagents(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.subagents).groupBy("agent_type", "resolved_model")
    rows = rows.agg(*exprs(runs="count(1)", total_tokens="sum(total_tokens)", avg_duration_ms="round(avg(total_duration_ms), 0)", tool_uses="sum(tool_use_count)"))
    return rows.withColumn("agent_type", F.coalesce("agent_type", F.lit("(default)")))


@query
def effort(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.messages).where("type = 'assistant'").groupBy(F.expr("coalesce(effort, '(unset)')").alias("effort")).agg(*exprs(messages="count(1)", thinking_blocks="sum(thinking_blocks)"))


@query
def stop_reasons(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.messages).where("type = 'assistant'").groupBy(F.expr("coalesce(stop_reason, '(none)')").alias("stop_reason")).agg(*exprs(n="count(1)"))


@query
def events(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.events).groupBy("kind", F.expr("coalesce(subkind, '')").alias("subkind")).agg(*exprs(n="count(1)"))
    return top(rows, 40, F.desc("n"), F.asc("kind"), F.asc("subkind"))


@query
def turns_daily(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.turns).where("date IS NOT NULL").groupBy("date").agg(*exprs(turns="count(1)", avg_turn_s="round(avg(duration_ms) / 1000D, 1)", total_turn_min="round(sum(duration_ms) / 60000D, 1)"))


@query
def legacy_daily(m, f: Filters = EVERYTHING) -> DataFrame:
    return m.legacy_days.select("date", "messages", "sessions", "tool_calls", "tokens")


@query
def legacy_models(m, f: Filters = EVERYTHING) -> DataFrame:
    return m.legacy_models.withColumn("total_tokens", F.expr("input_tokens + output_tokens + cache_read + cache_write"))


@query
def legacy_only(m, f: Filters = EVERYTHING) -> DataFrame:
    """Days before the first one with responses of its own."""
    first = m.messages.agg(F.min("date").alias("live"))
    only = m.legacy_days.join(first, F.lit(True)).where("live IS NULL OR date < live")
    return only.agg(*exprs(days_only_in_cache="count(1)", messages_only_in_cache="coalesce(sum(messages), 0)", live_first_day="max(live)"))


@query
def legacy_meta(m, f: Filters = EVERYTHING) -> DataFrame:
    """Totals that the roll-up cache keeps beside its lists."""
    return m.legacy_meta.select("key", "value")


@query
def streaks(m, f: Filters = EVERYTHING) -> DataFrame:
    """Longest run of days, the run that ends on the last active day, and days in all.

    The windows see one row a day.
    """
    days = m.messages.where("date IS NOT NULL").select(F.col("date").cast("date").alias("d")).distinct()
    island = days.withColumn("start", F.expr("date_sub(d, CAST(row_number() OVER (ORDER BY d) AS INT))"))
    runs = island.groupBy("start").agg(*exprs(n="count(1)", ends="max(d)", begins="min(d)"))
    return runs.agg(*exprs(longest="coalesce(max(n), 0)", current="coalesce(max_by(n, ends), 0)", days="coalesce(sum(n), 0)", first_day="CAST(min(begins) AS STRING)", last_day="CAST(max(ends) AS STRING)"))


@query
def pricing_warnings(m, f: Filters = EVERYTHING) -> DataFrame:
    """Models whose rates aren't official."""
    used = m.messages.where("model IS NOT NULL").select("model").distinct()
    return pricing.with_rates(used).where("price_confidence <> 'official'").select("model", F.col("price_confidence").alias("confidence"))


@query
def ingest_runs(m, f: Filters = EVERYTHING) -> DataFrame:
    return top(m.runs, 6, F.desc("id")).select("source", "files_seen", "files_read", "rows_added", "note")
