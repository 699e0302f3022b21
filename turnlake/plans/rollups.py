"""Roll-ups: sketches for any range of days, all choices of dimensions at once, active spans, and what changed.

Distinct counts and quantiles come from sketches, without the rows behind them.
Their results are estimates, so each query has the exact figures beside it and
says whether the estimate is within its bound; SQL tells the exact ones. Users
call :func:`usage_rollup` and :func:`tool_rollup` once, :func:`write` to keep
them by day, and :func:`turnlake.operators.sketches.merged` for each question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.filters import EVERYTHING, Filters
from turnlake.operators import sketches, snapshots, spans
from turnlake.plans.catalogue import COST, STAMP, query
from turnlake.sources.scratch import cut

QUANTILES = {"p50": 0.5, "p90": 0.9}


def usage_rollup(m) -> DataFrame:
    """By day and project: responses and tokens, and sketches of sessions, branches and responses."""
    billed = F.when(F.col("usage_dupe") == 0, 1).otherwise(0)
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_write") + F.col("cache_read")
    distinct = {"sessions": F.col("session_id"), "branches": F.col("git_branch"), "responses": F.coalesce("message_id", "request_id")}
    return sketches.rollup(m.messages, ["date", "project"], distinct, {}, {"api_calls": billed, "total_tokens": tokens})


def tool_rollup(m) -> DataFrame:
    """By day, project and tool: calls and errors, sketches of files and sessions, and of waiting times."""
    distinct = {"files": F.col("file_path"), "sessions": F.col("session_id")}
    return sketches.rollup(m.tools, ["date", "project", "name"], distinct, {"latency": F.col("latency_ms")}, {"calls": F.lit(1), "errors": F.col("is_error")})


def write(rows: DataFrame, path: str) -> None:
    """Keeps a roll-up by day; days that are there already are replaced."""
    rows.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


@query
def approx_projects(m, f: Filters = EVERYTHING) -> DataFrame:
    """Sessions, branches and responses of each project from merged sketches, beside the exact counts."""
    told = sketches.merged(f.apply(cut(usage_rollup(m), "usage_rollup")), ["project"])
    names = ("sessions", "branches", "responses")
    exact = f.apply(m.messages).withColumn("responses", F.coalesce("message_id", "request_id")).groupBy(F.col("project").alias("of")).agg(
        *[F.count_distinct(c).alias(f"exact_{name}") for name, c in zip(names, ("session_id", "git_branch", "responses"))]
    )
    both = told.join(exact, F.col("project").eqNullSafe(F.col("of")))
    return both.select("project", "api_calls", "total_tokens", *[F.col(f"exact_{n}") for n in names], *[sketches.hll_close(F.col(n), F.col(f"exact_{n}")).alias(f"{n}_close") for n in names])


@query
def approx_tools(m, f: Filters = Filters("2024-01-05", "2024-01-20")) -> DataFrame:
    """Files, and median and nine tenths of waiting, of each tool over some days, from merged sketches; ranks of the values are looked up in the rows."""
    told = cut(sketches.merged(f.apply(cut(tool_rollup(m), "tool_rollup")), ["name"], QUANTILES), "told")
    rows = f.apply(m.tools).join(told.select(F.col("name").alias("of"), *[f"latency_{q}" for q in QUANTILES]), F.col("name") == F.col("of"))
    n = F.count("latency_ms")
    counts = [c for q in QUANTILES for c in (F.count_if(F.col("latency_ms") < F.col(f"latency_{q}")).alias(f"below_{q}"), F.count_if(F.col("latency_ms") <= F.col(f"latency_{q}")).alias(f"upto_{q}"))]
    exact = rows.groupBy("name").agg(F.count_distinct("file_path").alias("exact_files"), n.alias("n"), *counts)
    both = told.select("name", "calls", "errors", "files").join(exact, "name")
    # The value's ranks reach the one asked for, give or take the sketch's error.
    slack = 3 * sketches.RANK
    near = [((F.col(f"below_{q}") <= (p + slack) * F.col("n") + 1) & (F.col(f"upto_{q}") >= (p - slack) * F.col("n") - 1)).alias(f"{q}_close") for q, p in QUANTILES.items()]
    return both.select("name", "calls", "errors", "exact_files", sketches.hll_close(F.col("files"), F.col("exact_files")).alias("files_close"), "n", *near)


@query
def usage_cube(m, f: Filters = EVERYTHING) -> DataFrame:
    """Usage by every choice of day, project and model at once; ``level`` has a bit for each that is summed over.

    Lines are summed by day, project, model and session first, in one pass over
    them; only these sums are multiplied by the eight choices.
    """
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_write") + F.col("cache_read")
    once = f.apply(m.messages).groupBy("date", "project", "model", "session_id").agg(
        F.sum(F.when(F.col("usage_dupe") == 0, 1).otherwise(0)).alias("api_calls"), F.sum(tokens).alias("total_tokens"), F.sum("tool_uses").alias("tool_uses"), F.sum("cost_usd").alias("cost_usd")
    )
    return once.cube("date", "project", "model").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("api_calls").alias("api_calls"), F.count_distinct("session_id").alias("sessions"), F.sum("total_tokens").alias("total_tokens"), F.sum("tool_uses").alias("tool_uses"),
        F.expr(COST).alias("cost_usd"),
    )


@query
def active_spans(m, f: Filters = EVERYTHING) -> DataFrame:
    """Stretches of each session without a pause of over half an hour."""
    tokens = (F.col("input_tokens") + F.col("output_tokens")).alias("tokens")
    rows = spans.active(f.apply(m.messages).select("session_id", "ts", tokens))
    return rows.withColumns({c: F.date_format(c, STAMP) for c in ("started", "ended")})


@query
def tool_changes(m, f: Filters = EVERYTHING, until: str = "2024-01-20") -> DataFrame:
    """Calls of each tool on each file of a project: what came, and what became more, since a day."""
    rows = f.apply(m.tools).where("file_path IS NOT NULL")
    counts = lambda part: part.groupBy("project", "file_path", "name").agg(F.count(F.lit(1)).alias("calls"))
    return snapshots.changes(counts(rows.where(F.col("date") <= until)), counts(rows), ["project", "file_path", "name"])
