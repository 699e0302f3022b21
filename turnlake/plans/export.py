"""Results at the edge: JSON by query, the prompt corpus as text, and a brief of what repeats."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.filters import EVERYTHING, Filters
from turnlake.plans import mining
from turnlake.plans.catalogue import CATALOGUE


def payload(model, path: str, names: Iterable[str] | None = None, f: Filters = EVERYTHING) -> None:
    """Writes the rows of each query as JSON lines to a folder of its name under ``path``."""
    for name in names or CATALOGUE:
        CATALOGUE[name](model, f).write.mode("overwrite").json(f"{path}/{name}")


def corpus(model, f: Filters = EVERYTHING) -> DataFrame:
    """Lines of the prompt corpus (project, place, value): sessions by project, a heading before each one's prompts."""
    rows = mining.prompt_corpus(model, f)
    in_session = Window.partitionBy("project", "session_id").orderBy("date", "uuid")
    rows = rows.withColumn("k", F.row_number().over(in_session))
    heading = F.concat(F.lit("SESSION "), F.left("session_id", F.lit(8)), F.lit(" "), F.coalesce("date", F.lit("")))
    return rows.select("project", F.struct("session_id", "k").alias("place"), F.concat(F.when(F.col("k") == 1, F.concat(heading, F.lit("\n"))).otherwise(""), F.lit("- "), "text").alias("value"))


def write_corpus(model, path: str, f: Filters = EVERYTHING) -> None:
    """The corpus as text files, one folder a project, in order within and over the files of each.

    Projects are dealt out by ranges of project and place, so that a large one is written by several tasks.
    """
    corpus(model, f).repartitionByRange("project", "place").sortWithinPartitions("project", "place").select("project", "value").write.mode("overwrite").partitionBy("project").text(path)


#: Sections of a brief: heading, query, columns (all, where there are none), rows at most.
REPEATS = (
    ("Counts", "overview_prompts", ("prompts",), 1), ("Sessions", "habit_counts", ("sessions", "interactive_sessions", "one_prompt_sessions"), 1), ("Prompts per session", "prompts_per_session", (), 1),
    ("Actions per prompt", "actions_per_prompt", (), 1), ("Corrections", "habit_ratios", (), 1), ("Sent too early", "premature_sends", (), 1),
    ("Projects by prompts", "prompt_projects", ("project", "prompts", "sessions"), 15), ("Intents", "intent_counts", ("intent", "n", "pct"), 14), ("Slash commands", "slash_usage", ("name", "n", "sessions"), 20),
    ("Exact repeats", "families", ("size", "sessions", "projects", "example"), 20), ("Clusters", "clusters", ("size", "sessions", "projects", "first_day", "last_day", "keywords", "examples"), 20), ("Phrases", "phrases", ("phrase", "sessions", "n"), 40),
    ("Openers", "openers", ("kind", "n"), 10), ("Sub-agent instructions", "agent_prompts", ("n", "head"), 10),
)
METRICS = (
    ("Messages", "overview_messages", (), 1), ("Derived", "overview_derived", (), 1), ("Tools", "overview_tools", (), 1), ("Prompts", "overview_prompts", (), 1), ("Time", "time_coverage", (), 1), ("Source lines", "source_lines", (), 1),
    ("Actions per prompt", "actions_per_prompt", (), 1), ("Prompts per session", "prompts_per_session", (), 1), ("Habits", "habit_counts", (), 1), ("Ratios", "habit_ratios", (), 1), ("Prompt shape", "prompt_shape", (), 1),
    ("Sent too early", "premature_sends", (), 1), ("Delegation", "delegation", (), 1), ("Reruns", "redundant_reruns", (), 1), ("Intents", "intent_counts", ("intent", "pct"), 8),
    ("Errors", "errors", (), 20), ("Sessions that switch models", "model_switches", (), 1), ("Sessions without tools", "zero_tool", (), 1), ("Much spent, few tools", "high_burn_low_tool", ("title", "cost_usd"), 12),
    ("Searching sessions", "search_heavy", ("title", "cost_usd"), 12), ("Dear tool calls", "cost_outliers", ("title", "cost_per_tool"), 12), ("Other models", "routing_counterfactual", (), 12),
    ("Git", "git_totals", (), 1), ("Issues", "ticket_totals", (), 1), ("Ledger", "ticket_ledger", ("key", "status", "sessions"), 10), ("Lines by category", "lines_by_category", ("category", "added"), 10),
    ("Models", "models", ("model", "messages", "cost_usd", "price_confidence"), 6), ("Projects by cost", "projects", ("project", "cost_usd", "sessions", "lines_added"), 8), ("Heaviest sessions", "sessions", ("title", "project", "cost_usd", "messages", "tool_uses"), 6),
)
#: Sections whose query comes in no order: by what the most comes first.
FIRST = {"intent_counts": "n", "openers": "n", "models": "cost_usd", "projects": "cost_usd", "lines_by_category": "added", "families": "sessions"}


def _written(model, title: str, sections: tuple, f: Filters, most: int) -> str:
    out = [title]
    if f != EVERYTHING:
        out.append(f"Filter: since {f.since}, until {f.until}, project {f.project}")
    for heading, name, columns, n in sections:
        rows = CATALOGUE[name](model, f)
        if name in FIRST:
            rows = rows.orderBy(F.desc(FIRST[name]), *[c for c in columns if c != FIRST[name]][:1])
        found = rows.limit(n).collect()
        names = [c for c in columns or rows.columns]
        out += ["", f"## {heading}"]
        # A single row of totals has a line for each, lists have one for each row.
        out += [f"- {c}: {r[c]}" for r in found for c in names] if n == 1 else ["- " + "; ".join(f"{c}: {r[c]}" for c in names) for r in found]
    return "\n".join(out)[:most]


def brief(model, f: Filters = EVERYTHING, most: int = 60_000) -> str:
    """A text of what repeats, for people; every section is a report of a few rows."""
    return _written(model, "# What repeats", REPEATS, f, most)


def metrics_brief(model, f: Filters = EVERYTHING, most: int = 60_000) -> str:
    """A text of what was measured, for people."""
    return _written(model, "# What was measured", METRICS, f, most)
