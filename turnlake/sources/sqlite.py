"""Tables of a SQLite file as DataFrames, read-only, in pieces by row id; and the chat store's model tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from functools import cached_property
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from turnlake.functions import paths, times
from turnlake.operators import chats
from turnlake.sources.transcripts import get

# What the store's numbers mean.
ROLES = {1: "user", 2: "assistant"}
MODES = {1: "chat", 2: "agent", 3: "edit"}


def open_ro(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, timeout=20)


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class TableReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], rows: int):
        self.path, self.table, self.columns, self.rows = path, table, columns, rows

    def partitions(self) -> list[Rows]:
        with open_ro(self.path) as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [Rows(k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)] if low is not None else []

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with open_ro(self.path) as con:
            for row in con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high)):
                yield tuple(x.decode("utf-8", "replace") if isinstance(x, bytes) else None if x is None else str(x) for x in row)


class SqliteSource(DataSource):
    """Options: path, table, columns (comma-joined), rows (of a piece). All columns come as texts."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _columns(self) -> list[str]:
        return self.options["columns"].split(",")

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self._columns())

    def reader(self, schema) -> TableReader:
        return TableReader(self.options["path"], self.options["table"], self._columns(), int(self.options.get("rows", 50_000)))


def table(spark: SparkSession, path: str, name: str, *columns: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", name).option("columns", ",".join(columns)).load()


class ChatStore:
    """Model tables of the second source: a key/value store of chats, and a file of conversation titles."""

    def __init__(self, spark: SparkSession, state: str, titles: str | None = None, workspaces: DataFrame | None = None):
        self.spark, self.state, self.titles_path, self.workspaces = spark, state, titles, workspaces

    @cached_property
    def chat_sessions(self) -> DataFrame:
        rows = table(self.spark, self.state, "composerHeaders", "composerId", "workspaceId", "createdAt", "lastUpdatedAt", "isArchived", "isSubagent", "value").withColumn("v", F.try_parse_json("value"))
        if self.workspaces is not None:
            rows = rows.join(self.workspaces.select(F.col("workspace_id").alias("workspaceId"), F.col("folder").alias("workspace")), "workspaceId", "left")
        else:
            rows = rows.withColumn("workspace", F.lit(None).cast("string"))
        created, updated = times.parsed(F.coalesce("createdAt", get("createdAt"))), times.parsed(F.coalesce("lastUpdatedAt", get("lastUpdatedAt"), get("conversationCheckpointLastUpdatedAt")))
        repo, mode = F.coalesce(get("trackedGitRepos[0].repoPath"), F.col("workspace")), get("unifiedMode")
        flag = lambda c: (~F.coalesce(F.col(c), F.lit("0")).isin("0", "", "None")).cast("int")
        named = F.create_map(*[F.lit(x) for k, v in MODES.items() for x in (str(k), v)])
        return rows.select(
            F.col("composerId").alias("composer_id"), get("name").alias("name"), created.alias("created_at"), updated.alias("last_updated_at"), times.day(created).alias("date"), F.coalesce(F.try_element_at(named, mode), mode).alias("mode"),
            flag("isArchived").alias("is_archived"), flag("isSubagent").alias("is_subagent"), get("subagentInfo.parentComposerId").alias("parent_composer"), get("contextUsagePercent", "double").alias("context_usage_pct"),
            *[F.coalesce(get(k, "long"), F.lit(0)).alias(c) for c, k in (("lines_added", "totalLinesAdded"), ("lines_removed", "totalLinesRemoved"), ("files_changed", "filesChangedCount"))],
            repo.alias("repo_path"), F.when(repo.isNotNull(), paths.project_of(repo, F.lit(None).cast("string"))).alias("project"), get("trackedGitRepos[0].branches[0].branchName").alias("branch"), F.nullif(F.left(get("subtitle"), F.lit(300)), F.lit("")).alias("subtitle"),
        )

    def new_messages(self, known: DataFrame | None = None) -> DataFrame:
        """Messages of the store; with ``known`` (bubble_key) only those that aren't in it."""
        rows = table(self.spark, self.state, "cursorDiskKV", "key", "value").where("key LIKE 'bubbleId:%'")
        if known is not None:
            rows = rows.join(known.select(F.col("bubble_key").alias("key")), "key", "left_anti")
        rows = rows.withColumn("v", F.try_parse_json("value")).where(F.schema_of_variant("v").startswith("OBJECT"))
        parts, size = F.split("key", ":"), lambda k: F.coalesce(F.size(get(k, "array<variant>")), F.lit(0))
        sent, settled = get("timingInfo.clientRpcSendTime", "double"), get("timingInfo.clientSettleTime", "double")
        ts, kind = times.parsed(get("timingInfo.clientRpcSendTime")), get("type")
        role = F.create_map(*[F.lit(x) for k, v in ROLES.items() for x in (str(k), v)])
        return rows.select(
            F.col("key").alias("bubble_key"), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).alias("composer_id"), F.coalesce(F.try_element_at(role, kind), kind).alias("role"), F.coalesce(F.length(get("text")), F.lit(0)).alias("text_chars"),
            F.greatest(size("allThinkingBlocks"), F.lit(0)).alias("thinking_blocks"), F.greatest(size("codeBlocks"), F.lit(0)).alias("code_blocks"), get("toolFormerData.name").alias("tool_name"), get("toolFormerData.status").alias("tool_status"),
            (~F.coalesce(F.to_json(get("toolFormerData.error", "variant")), F.lit("null")).isin("null", "false", '""', "0", "{}", "[]")).cast("int").alias("tool_error"),
            F.coalesce(get("tokenCount.inputTokens", "long"), F.lit(0)).alias("input_tokens"), F.coalesce(get("tokenCount.outputTokens", "long"), F.lit(0)).alias("output_tokens"), ts.alias("ts"), times.day(ts).alias("date"), F.hour(ts).alias("hour"),
            F.when(settled >= sent, (settled - sent).cast("long")).alias("duration_ms"),
        )

    @cached_property
    def chat_messages(self) -> DataFrame:
        return chats.backfilled(self.new_messages(), self.chat_sessions)

    @cached_property
    def ai_lines(self) -> DataFrame:
        """Attributed lines of one cell, the last of each hash."""
        cell = table(self.spark, self.state, "ItemTable", "key", "value").where("key = 'aiCodeTrackingLines'")
        rows = cell.select(F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("k", "v"))
        ext, name = get("metadata.fileExtension"), get("metadata.fileName")
        rows = rows.select("k", get("hash").alias("hash"), get("metadata.composerId").alias("composer_id"), get("metadata.source").alias("source"), name.alias("file_name"), F.coalesce(F.concat(F.lit("."), F.lower(F.nullif(ext, F.lit("")))), paths.extension(name)).alias("file_ext"))
        return rows.groupBy("hash").agg(F.max_by(F.struct("composer_id", "source", "file_name", "file_ext"), "k").alias("x")).select("hash", "x.*")

    @cached_property
    def chat_titles(self) -> DataFrame:
        rows = table(self.spark, self.titles_path, "conversations", "id", "source", "title", "updated_at", "is_archived")
        ts = times.parsed(F.col("updated_at"))
        return rows.select("id", "source", "title", ts.alias("updated_at"), times.day(ts).alias("date"), F.col("is_archived").cast("int").alias("is_archived"))


def workspace_folders(spark: SparkSession, top: str) -> DataFrame:
    """workspace_id and folder of every ``workspace.json`` under ``top``."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "workspace.json").text(top)
    rows = rows.select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file"))
    folder = F.url_decode(F.regexp_replace(F.coalesce(get("folder"), get("workspace")), r"^[a-z-]+://[^/]*", ""))
    return rows.select(F.regexp_extract("file", r"/([^/]+)/workspace\.json$", 1).alias("workspace_id"), F.rtrim(folder, F.lit("/")).alias("folder"))
