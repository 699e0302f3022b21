"""Delivery: git outcomes, lines by kind of file, issues, and the long history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.filters import EVERYTHING, Filters
from turnlake.functions import paths, text
from turnlake.plans.behaviour import facts
from turnlake.plans.catalogue import exprs, query, top


@query
def git_outcomes(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.git).select("kind", F.when(F.col("kind") == "push", F.substring_index("key", ":", -2)).otherwise(F.col("key")).alias("key"), "branch", "subject", "files", "insertions", "deletions")


@query
def git_totals(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.git).agg(
        *exprs(
            commits="count_if(kind = 'commit')", pushes="count_if(kind = 'push')", prs="count_if(kind = 'pr')", commit_files="coalesce(sum(files), 0)",
            commit_insertions="coalesce(sum(insertions), 0)", commit_deletions="coalesce(sum(deletions), 0)",
        )
    )


@query
def commits_by_project(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.git).where("kind = 'commit'").groupBy("project").agg(*exprs(commits="count(1)", insertions="sum(insertions)", deletions="sum(deletions)", sessions="count(DISTINCT session_id)"))
    return top(rows, 15, F.desc("commits"), F.asc("project"))


@query
def commits_daily(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.git).where("kind = 'commit' AND date IS NOT NULL").groupBy("date").agg(*exprs(commits="count(1)", insertions="sum(insertions)"))


@query
def recent_commits(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = top(f.apply(m.git).where("kind = 'commit'"), 60, F.desc("ts"), F.asc("key"))
    return rows.select("key", "date", "project", "branch", "subject", "files", "insertions", "deletions")


@query
def prs(m, f: Filters = EVERYTHING) -> DataFrame:
    return top(f.apply(m.git).where("kind = 'pr'"), 40, F.desc("ts"), F.asc("key")).select("date", "project", F.col("subject").alias("url"))


def _categories(m, f: Filters) -> DataFrame:
    edits = f.apply(m.tools).where(F.col("name").isin(*paths.MUTATING_TOOLS))
    rows = edits.groupBy(paths.file_category(F.col("file_ext")).alias("category"))
    return rows.agg(*exprs(added="coalesce(sum(lines_added), 0)", removed="coalesce(sum(lines_removed), 0)", touches="count(1)"))


@query
def lines_by_category(m, f: Filters = EVERYTHING) -> DataFrame:
    return _categories(m, f)


@query
def source_lines(m, f: Filters = EVERYTHING) -> DataFrame:
    return _categories(m, f).where(F.col("category").isin(*paths.SOURCE_CATEGORIES)).agg(*exprs(source_added="coalesce(sum(added), 0)", source_removed="coalesce(sum(removed), 0)"))


@query
def git_subcommands(m, f: Filters = EVERYTHING) -> DataFrame:
    said = f.apply(m.tools).where("bash_command ILIKE '%git %'").select(F.explode(text.git_subcommands(F.col("bash_command"))).alias("cmd"))
    return top(said.groupBy("cmd").agg(*exprs(n="count(1)")), 15, F.desc("n"), F.asc("cmd"))


@query
def ticket_keys(m, f: Filters = EVERYTHING) -> DataFrame:
    """Issue keys in human prompts."""
    return f.apply(m.prompts).select(F.explode("tickets").alias("key")).groupBy("key").agg(*exprs(n="count(1)"))


def _ledger(m, f: Filters) -> DataFrame:
    """Per issue its evidence, and whether its prefix looks like a tracker's: two issues, or a commit or branch."""
    kinds = ("commit", "branch", "title", "prompt", "file", "lookup")
    per = f.apply(m.tickets).groupBy("key").agg(
        *exprs(sessions="count(DISTINCT session_id)", projects="array_join(sort_array(collect_set(project)), ',')", first_day="min(date)", last_day="max(date)"),
        *[F.coalesce(F.sum(F.when(F.col("evidence") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in kinds],
    )
    of_prefix = Window.partitionBy("prefix")
    strong = F.max(((F.col("n_commit") > 0) | (F.col("n_branch") > 0)).cast("int")).over(of_prefix)
    rows = per.withColumn("prefix", F.expr("substring_index(key, '-', 1)"))
    return rows.withColumn("kept", (F.count(F.lit(1)).over(of_prefix) >= 2) | (strong == 1))


STATUS = "CASE WHEN n_commit > 0 THEN 'delivered' WHEN n_branch > 0 OR n_title > 0 OR n_prompt > 0 OR n_file > 0 THEN 'worked' ELSE 'referenced' END"


@query
def ticket_ledger(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = _ledger(m, f).where("kept").withColumn("status", F.expr(STATUS)).drop("prefix", "kept")
    rank = F.when(F.col("status") == "delivered", 0).when(F.col("status") == "worked", 1).otherwise(2)
    return rows.orderBy(rank, F.desc("n_commit"), F.desc("sessions"), "key")


@query
def ticket_totals(m, f: Filters = EVERYTHING) -> DataFrame:
    """How many issues the ledger has, and how many of them were delivered or worked on."""
    return ticket_ledger(m, f).agg(*exprs(ticket_count="count(1)", tickets_delivered="count_if(status = 'delivered')", tickets_worked="count_if(status = 'worked')"))


@query
def dropped_prefixes(m, f: Filters = EVERYTHING) -> DataFrame:
    return top(_ledger(m, f).where("NOT kept").select("prefix").distinct(), 40, F.asc("prefix"))


@query
def time_coverage(m, f: Filters = EVERYTHING) -> DataFrame:
    return facts(m, f).agg(
        *exprs(
            active_hours="round(coalesce(sum(turn_ms), 0) / 3600000, 1)", timed_sessions="count_if(turn_ms > 0)",
            time_coverage_pct="coalesce(round(sum(CASE WHEN turn_ms > 0 THEN total_tokens ELSE 0 END) / nullif(sum(total_tokens), 0) * 100, 1), 0)", cost_usd="round(sum(cost_usd), 2)",
        )
    )


@query
def roi_model(m, f: Filters = EVERYTHING, lines_per_hour: float = 60.0, rate: float = 75.0) -> DataFrame:
    """Value of the source lines written at a person's pace and rate, over what they cost."""
    cost = f.apply(m.messages).agg(*exprs(cost="sum(cost_usd)"))
    value = F.col("source_added") / lines_per_hour * rate
    return source_lines(m, f).join(cost, F.lit(True)).select(
        (F.round(F.col("source_added") / lines_per_hour, 1)).alias("hours"), F.round(value, 2).alias("value_usd"), F.round(value / F.nullif("cost", F.lit(0.0)), 1).alias("multiple")
    )


@query
def churn_ratio(m, f: Filters = EVERYTHING) -> DataFrame:
    """Removed over added lines, reads over other input tokens, and cost for a thousand source lines."""
    lines = f.apply(m.tools).agg(*exprs(added="sum(lines_added)", removed="sum(lines_removed)"))
    tokens = f.apply(m.messages).agg(*exprs(reads="sum(cache_read)", paid="sum(input_tokens + cache_write)", cost="sum(cost_usd)"))
    return lines.join(tokens, F.lit(True)).join(source_lines(m, f), F.lit(True)).select(
        *exprs(churn_ratio="round(removed / nullif(added, 0), 4)", cache_leverage="round(reads / nullif(paid, 0), 2)", cost_per_kloc="round(cost / nullif(source_added, 0) * 1000, 2)")
    )


@query
def history_monthly(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = m.history.where("date IS NOT NULL").groupBy(F.left("date", F.lit(7)).alias("month"))
    return rows.agg(*exprs(prompts="count(1)", projects="count(DISTINCT project)", pasted="sum(pasted)", slash="sum(is_slash)"))


@query
def history_totals(m, f: Filters = EVERYTHING) -> DataFrame:
    return m.history.agg(*exprs(prompts="count(1)", first_day="min(date)", last_day="max(date)", projects="count(DISTINCT project)", pasted="sum(pasted)"))


def _lost(m) -> DataFrame:
    old = m.history.where("project IS NOT NULL").groupBy("project_path").agg(*exprs(project="max(project)", prompts="count(1)", first_day="min(date)", last_day="max(date)"))
    live = m.sessions.where("project IS NOT NULL").select("project").distinct()
    folder = F.regexp_replace("project_path", r"[^\p{L}\p{N}]", "-")
    return old.join(live, "project", "left_anti").withColumn("folder", folder).join(m.folders, "folder", "left_anti").drop("folder")


@query
def lost_projects(m, f: Filters = EVERYTHING) -> DataFrame:
    """Projects of the history of which neither a session nor a folder is left."""
    return top(_lost(m), 25, F.desc("prompts"), F.asc("project_path"))


@query
def prompts_before_transcripts(m, f: Filters = EVERYTHING) -> DataFrame:
    first = m.messages.agg(F.min("date").alias("live"))
    return m.history.join(first, F.lit(True)).agg(*exprs(prompts_before_transcripts="count_if(date < coalesce(live, '0000'))", transcript_first_day="max(live)"))
