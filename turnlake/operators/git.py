"""Git outcomes in recorded shell output, and evidence of work on issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import text


def outcomes(shell: DataFrame, order: Sequence[str]) -> DataFrame:
    """Commits, pushes and pull requests in ``stdout``; of each kind and key the first by ``order``.

    Commits are told by their hash, pull requests by their url, and pushes by
    session, time and remote.
    """
    none = F.lit(None)
    commit = F.transform(text.commits(F.col("stdout")), lambda c: F.struct(F.lit("commit").alias("kind"), c["sha"].alias("key"), c["branch"].alias("branch"), c["subject"].alias("subject"), c["files"].alias("files"), c["insertions"].alias("insertions"), c["deletions"].alias("deletions")))
    plain = lambda kind, key, subject: F.struct(F.lit(kind).alias("kind"), key.alias("key"), none.cast("string").alias("branch"), subject.alias("subject"), none.cast("int").alias("files"), none.cast("int").alias("insertions"), none.cast("int").alias("deletions"))
    push = F.transform(text.pushes(F.col("stdout")), lambda r: plain("push", F.concat_ws(":", "session_id", F.col("ts").cast("string"), r), none.cast("string")))
    pull = F.transform(text.pull_requests(F.col("stdout")), lambda u: plain("pr", u, u))
    found = shell.withColumn("x", F.explode(F.concat(commit, push, pull))).select("session_id", "project", "ts", "date", *[c for c in order if c != "ts"], "x.*")
    first = Window.partitionBy("kind", "key").orderBy(*order)
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", *[c for c in order if c != "ts"])


def evidence(rows: DataFrame, kind: str, keys) -> DataFrame:
    """key, session_id, project, date, evidence and n for the issue keys in an array column of ``rows``."""
    found = rows.where(F.col("session_id").isNotNull()).select("session_id", "project", "date", F.explode(keys).alias("key"))
    first = F.min_by("project", F.struct(F.coalesce("date", F.lit("9999")), "project")).alias("project")
    return found.groupBy("key", "session_id").agg(first, F.min("date").alias("date"), F.count(F.lit(1)).alias("n")).withColumn("evidence", F.lit(kind))


def ticket_evidence(model) -> DataFrame:
    """All evidence of a model's tables: titles, branches, prompts, files, commits, and lookups in a tracker's tools."""
    dated = model.sessions.withColumn("date", F.date_format("first_ts", "yyyy-MM-dd"))
    title = F.concat_ws(" ", "ai_title", "custom_title")
    branch = evidence(dated, "branch", text.tickets(F.col("git_branch"))).withColumn("n", F.lit(1).cast("long"))
    lookups = model.tools.where("is_mcp = 1 AND name ILIKE '%atlassian%'")
    parts = [
        evidence(dated, "title", text.tickets(title)), branch, evidence(model.prompts, "prompt", F.col("tickets")),
        evidence(model.tools, "file", text.tickets(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")))), evidence(model.git.where("kind = 'commit'"), "commit", text.tickets(F.col("subject"))),
        evidence(lookups, "lookup", text.tickets(F.col("input"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
