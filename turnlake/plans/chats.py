"""The second source's reports; they show all of it whatever the filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.filters import EVERYTHING, Filters
from turnlake.operators import chats
from turnlake.plans.catalogue import exprs, query, top

#: Lines that the source keeps at most; with as many it is a recent sample.
AI_LINES_KEPT = 10_000


def _counted(m) -> DataFrame:
    return chats.counted(m.chat_sessions, m.chat_messages)


@query
def cur_overview(m, f: Filters = EVERYTHING) -> DataFrame:
    """Totals of each table, one row each, side by side."""
    s = m.chat_sessions.agg(
        *exprs(
            sessions="count(1)", lines_added="sum(lines_added)", lines_removed="sum(lines_removed)", files_changed="sum(files_changed)", subagent_sessions="sum(is_subagent)", archived="sum(is_archived)",
            avg_context_pct="round(avg(context_usage_pct), 1)", projects="count(DISTINCT project)", first_day="min(date)", last_day="max(date)",
        )
    )
    n = m.chat_messages.agg(
        *exprs(
            messages="count(1)", user_messages="count_if(role = 'user')", assistant_messages="count_if(role = 'assistant')", tool_calls="count(tool_name)", text_chars="sum(text_chars)", thinking_blocks="sum(thinking_blocks)",
            code_blocks="sum(code_blocks)", input_tokens="sum(input_tokens)", output_tokens="sum(output_tokens)", active_days="count(DISTINCT date)",
            ts_exact="count_if(ts_source = 'exact')", ts_inferred="count_if(ts_source = 'session')", ts_none="count_if(ts_source IS NULL)", ts_exact_pct="coalesce(round(count_if(ts_source = 'exact') / nullif(count(1), 0) * 100, 1), 0)",
        )
    )
    a = m.ai_lines.agg(*exprs(ai_lines="count(1)", ai_files="count(DISTINCT file_name)", ai_lines_capped=f"count(1) >= {AI_LINES_KEPT}"))
    c = m.chat_titles.agg(*exprs(conversations="count(1)"))
    return s.join(n, F.lit(True)).join(a, F.lit(True)).join(c, F.lit(True))


@query
def cur_daily(m, f: Filters = EVERYTHING) -> DataFrame:
    return m.chat_messages.where("date IS NOT NULL").groupBy("date").agg(*exprs(messages="count(1)", sessions="count(DISTINCT composer_id)", tool_calls="count(tool_name)", text_chars="sum(text_chars)"))


@query
def cur_tools(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = m.chat_messages.where("tool_name IS NOT NULL").groupBy(F.col("tool_name").alias("name"))
    return top(rows.agg(*exprs(calls="count(1)", errors="sum(tool_error)", completed="count_if(tool_status = 'completed')", avg_duration_ms="round(avg(duration_ms), 0)")), 40, F.desc("calls"), F.asc("name"))


@query
def cur_projects(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = _counted(m).groupBy(F.expr("coalesce(project, '(unknown)')").alias("project")).agg(
        *exprs(sessions="count(1)", lines_added="sum(lines_added)", lines_removed="sum(lines_removed)", files_changed="sum(files_changed)", messages="sum(message_count)", first_day="min(date)", last_day="max(date)")
    )
    return top(rows, 40, F.desc("messages"), F.asc("project"))


@query
def cur_sessions(m, f: Filters = EVERYTHING) -> DataFrame:
    columns = ("composer_id", "name", "project", "mode", "date", "lines_added", "lines_removed", "files_changed", "message_count", "context_usage_pct", "is_subagent", "subtitle")
    return top(_counted(m), 50, F.desc("message_count"), F.asc("composer_id")).select(*columns)


@query
def cur_modes(m, f: Filters = EVERYTHING) -> DataFrame:
    return _counted(m).groupBy(F.expr("coalesce(mode, '(unknown)')").alias("mode")).agg(*exprs(sessions="count(1)", messages="sum(message_count)", lines_added="sum(lines_added)"))


@query
def cur_ai_by_ext(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = m.ai_lines.groupBy(F.expr("coalesce(file_ext, '(none)')").alias("file_ext")).agg(*exprs(lines="count(1)", files="count(DISTINCT file_name)"))
    return top(rows, 25, F.desc("lines"), F.asc("file_ext"))


@query
def cur_ai_by_file(m, f: Filters = EVERYTHING) -> DataFrame:
    return top(m.ai_lines.groupBy("file_name").agg(*exprs(file_ext="max(file_ext)", lines="count(1)")), 30, F.desc("lines"), F.asc("file_name"))


@query
def cur_ai_by_source(m, f: Filters = EVERYTHING) -> DataFrame:
    return m.ai_lines.groupBy(F.expr("coalesce(source, '(none)')").alias("source")).agg(*exprs(lines="count(1)"))


@query
def cur_hourly(m, f: Filters = EVERYTHING) -> DataFrame:
    return m.chat_messages.where("hour IS NOT NULL").groupBy("hour").agg(*exprs(messages="count(1)"))
