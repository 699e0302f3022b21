"""Model tables from transcripts, the prompt history and the roll-up cache.

Transcripts are JSON lines under ``projects/<folder>/``. A record's content and
tool results may be a text, an array or an object, so records are kept as
variants and each table takes what it needs by path; a field of an unexpected
type is null rather than an error. The tables have the columns of the model
that queries read, so the whole catalogue runs on them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import paths, text, times
from turnlake.operators import git, prompts, responses, sessions

RESULT_TEXTS = ("stdout", "content", "result", "text")
#: Totals of the roll-up cache beside its lists.
CACHE_META = ("totalSessions", "totalMessages", "firstSessionDate", "lastComputedDate", "longestSession", "hourCounts")


def get(path: str, kind: str = "string", of: Column | str = "v") -> Column:
    return F.try_variant_get(of if isinstance(of, Column) else F.col(of), f"$.{path}", kind)


def parse(lines: DataFrame) -> DataFrame:
    """Lines (value, file) with the record as a variant v; null where a line isn't a JSON object."""
    v = F.try_parse_json("value")
    return lines.withColumn("v", F.when(F.ltrim("value").startswith("{"), v))


def located(lines: DataFrame) -> DataFrame:
    """Adds the folder, the kind of transcript and the workflow that a file's path tells."""
    inside = F.regexp_extract("file", r"/projects/(.+)$", 1)
    parts = F.split(F.regexp_replace(inside, r"^[^/]+/?", ""), "/")
    workflow = F.regexp_extract(inside, r"/workflows/([^/]+)(?=/)", 1)
    kind = F.when(F.array_contains(parts, "workflows"), "workflow").when(F.array_contains(parts, "subagents"), "subagent").otherwise("main")
    return lines.withColumns({"folder": F.regexp_extract(inside, r"^([^/]+)", 1), "transcript": kind, "workflow_id": F.nullif(F.url_decode(workflow), F.lit(""))})


class Transcripts:
    """Model tables of the files under ``home``, or of bronze lines (value, file, byte_offset) that were read before.

    Records are in order of file, then of their place in it: where several say
    something of one session, call or response, the first or last in this order
    counts, whatever their times are.
    """

    def __init__(self, spark: SparkSession, home: str, lines: DataFrame | None = None, records: DataFrame | None = None):
        self.spark, self.home, self._lines, self._records = spark, home.rstrip("/"), lines, records

    @cached_property
    def lines(self) -> DataFrame:
        """value, file and place (struct) of every line."""
        if self._lines is not None:
            return self._lines.select("value", "file", F.struct(F.col("byte_offset").alias("block"), F.lit(0).cast("long").alias("k")).alias("place"))
        found = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(f"{self.home}/projects")
        # Rows of one block of a file are read in order by one task; their numbers tell that order, if nothing else.
        return found.select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k")).alias("place"))

    @cached_property
    def records(self) -> DataFrame:
        if self._records is not None:
            return self._records
        rows = located(parse(self.lines)).where("v IS NOT NULL")
        ts = times.parsed(get("timestamp"))
        return rows.select(
            "v", "folder", "transcript", "workflow_id", get("type").alias("type"), F.coalesce(get("sessionId"), get("session_id")).alias("session_id"), get("uuid").alias("uuid"), ts.alias("ts"), times.day(ts).alias("date"),
            F.hour(ts).alias("hour"), F.weekday(ts).alias("dow"), get("cwd").alias("cwd"),
            F.coalesce(get("isSidechain", "boolean"), F.lit(False)).cast("int").alias("is_sidechain"), get("message.content", "array<variant>").alias("blocks"),
            F.when(get("message.content", "array<variant>").isNull(), get("message.content")).alias("plain"), F.struct("file", "place").alias("at"),
        )

    @cached_property
    def bad_lines(self) -> DataFrame:
        """Lines that are no JSON object, blank ones left out."""
        return parse(self.lines).where("v IS NULL AND trim(value) <> ''").select("value", "file")

    @cached_property
    def sessions(self) -> DataFrame:
        rows = self.records.select(
            "session_id", "at", "ts", "cwd", get("slug").alias("slug"), get("gitBranch").alias("git_branch"), get("version").alias("version"), get("entrypoint").alias("entrypoint"), F.col("folder").alias("project_dir"),
            get("aiTitle").alias("ai_title"), get("customTitle").alias("custom_title"), get("agentName").alias("agent_name"),
        )
        return sessions.folded(rows)

    def _labelled(self, rows: DataFrame) -> DataFrame:
        """With the project that the session's folder names, else the transcript's folder."""
        return sessions.relabelled(rows.withColumn("project", F.coalesce(F.nullif("folder", F.lit("")), F.lit("unknown"))), self.sessions).drop("folder")

    def _last(self, rows: DataFrame, *keys: str) -> DataFrame:
        """The last record of each key, as a repeated key replaces the one before."""
        columns = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "at").alias("x")).select(*keys, "x.*")

    @cached_property
    def message_lines(self) -> DataFrame:
        """Every line of a response as it was logged, replaced ones and repeats included."""
        r = self.records.where("type = 'assistant'")
        kind = lambda name: F.filter(F.coalesce("blocks", F.array().cast("array<variant>")), lambda b: get("type", of=b) == name)
        chars = lambda name, field: F.aggregate(kind(name), F.lit(0), lambda n, b: n + F.coalesce(F.length(get(field, of=b)), F.lit(0)))
        number = lambda path: F.coalesce(get(path, "long"), F.lit(0))
        said = F.filter(F.transform(kind("text"), lambda b: get("text", of=b)), lambda t: F.coalesce(t, F.lit("")) != "")
        return r.select(
            "uuid", "session_id", "folder", "ts", "date", "hour", "dow", "type", "transcript", "workflow_id", "is_sidechain", "at", get("message.model").alias("model"), get("message.id").alias("message_id"), get("requestId").alias("request_id"),
            number("message.usage.input_tokens").alias("input_tokens"), number("message.usage.output_tokens").alias("output_tokens"), number("message.usage.cache_creation_input_tokens").alias("cache_write"),
            number("message.usage.cache_read_input_tokens").alias("cache_read"), number("message.usage.cache_creation.ephemeral_5m_input_tokens").alias("eph_5m"), number("message.usage.cache_creation.ephemeral_1h_input_tokens").alias("eph_1h"),
            number("message.usage.server_tool_use.web_search_requests").alias("web_search_reqs"), number("message.usage.server_tool_use.web_fetch_requests").alias("web_fetch_reqs"),
            F.size(kind("tool_use")).alias("tool_uses"), F.size(kind("thinking")).alias("thinking_blocks"), chars("thinking", "thinking").alias("thinking_chars"), (chars("text", "text") + F.coalesce(F.length("plain"), F.lit(0))).alias("text_chars"),
            F.coalesce(get("isApiErrorMessage", "boolean"), F.lit(False)).cast("int").alias("is_api_error"), get("version").alias("version"), get("gitBranch").alias("git_branch"), get("attributionSkill").alias("skill"), get("effort").alias("effort"),
            get("message.stop_reason").alias("stop_reason"), F.coalesce("plain", F.get(said, F.lit(0))).alias("reply"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        rows = self.message_lines
        named = rows.where("uuid IS NOT NULL")
        rows = self._last(named, "uuid").unionByName(rows.where("uuid IS NULL"))
        error = F.when(F.col("is_api_error") == 1, "api_error").otherwise(text.error_kind(F.col("reply"), F.col("tool_uses")))
        return self._labelled(responses.priced(responses.billed_once(rows)).withColumn("error_kind", error).drop("reply", "at"))

    @cached_property
    def result_lines(self) -> DataFrame:
        """Every result of a tool call: what the block and the record's payload say."""
        r = self.records.where("type = 'user'").withColumn("b", F.explode(F.filter("blocks", lambda b: get("type", of=b) == "tool_result")))
        payload = lambda path, kind="string": get(f"toolUseResult.{path}", kind)
        texts = lambda blocks: F.aggregate(F.coalesce(blocks, F.array().cast("array<variant>")), F.lit(0), lambda n, b: n + F.coalesce(F.length(get("text", of=b)), F.lit(0)))
        pieces = [F.coalesce(texts(payload(k, "array<variant>")), F.lit(0)) + F.when(payload(k, "array<variant>").isNull(), F.coalesce(F.length(payload(k)), F.lit(0))).otherwise(0) for k in RESULT_TEXTS]
        is_object = F.schema_of_variant(get("toolUseResult", "variant")).startswith("OBJECT")
        own = F.when(F.coalesce(is_object, F.lit(False)), sum(pieces[1:], pieces[0])).otherwise(F.coalesce(F.when(get("toolUseResult", "array<variant>").isNull(), F.length(get("toolUseResult"))), texts(get("toolUseResult", "array<variant>"))))
        content = F.coalesce(F.when(get("content", "array<variant>", of=F.col("b")).isNull(), F.length(get("content", of=F.col("b")))), texts(get("content", "array<variant>", of=F.col("b"))))
        hunks = payload("structuredPatch", "array<struct<lines: array<string>>>")
        lines = F.flatten(F.coalesce(F.transform(hunks, lambda h: F.coalesce(h["lines"], F.array().cast("array<string>"))), F.array().cast("array<array<string>>")))
        starts = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign)))
        created = F.when((starts("+") == 0) & (payload("type") == "create"), F.regexp_count(payload("content"), F.lit("\n")) + 1)
        rows = r.select(
            get("tool_use_id", of=F.col("b")).alias("tool_use_id"), "at", F.col("ts").alias("result_ts"), F.col("session_id"), "folder", "date", F.coalesce(get("is_error", "boolean", of=F.col("b")), F.lit(False)).cast("int").alias("is_error"),
            F.coalesce(payload("interrupted", "boolean"), F.lit(False)).cast("int").alias("interrupted"), F.coalesce(payload("durationMs", "double"), payload("totalDurationMs", "double")).cast("long").alias("duration_ms"),
            payload("filePath").alias("result_path"), F.coalesce(created, starts("+")).alias("lines_added"), starts("-").alias("lines_removed"), get("toolDenialKind").alias("denial_kind"),
            F.coalesce(F.nullif(own, F.lit(0)), F.nullif(content, F.lit(0)), F.length(F.nullif(F.trim(payload("stderr")), F.lit(""))), F.lit(0)).alias("result_chars"),
            F.concat_ws("\n", F.nullif(payload("stdout"), F.lit("")), F.nullif(payload("stderr"), F.lit(""))).alias("stdout"), payload("agentType").alias("agent_type"), payload("resolvedModel").alias("resolved_model"),
            F.coalesce(payload("totalTokens", "long"), F.lit(0)).alias("total_tokens"), F.coalesce(payload("totalDurationMs", "long"), F.lit(0)).alias("total_duration_ms"), F.coalesce(payload("totalToolUseCount", "long"), F.lit(0)).alias("tool_use_count"),
        )
        return rows.where("tool_use_id IS NOT NULL")

    @cached_property
    def call_lines(self) -> DataFrame:
        """Every tool call as it was logged."""
        r = self.records.where("type = 'assistant'").withColumn("b", F.explode(F.filter("blocks", lambda b: get("type", of=b) == "tool_use")))
        b, name = F.col("b"), F.coalesce(get("name", of=F.col("b")), F.lit("?"))
        path = F.coalesce(*[F.nullif(get(f"input.{k}", of=b), F.lit("")) for k in ("file_path", "path", "notebook_path")])
        command, mcp = get("input.command", of=b), name.startswith("mcp__")
        given = F.to_json(F.coalesce(get("input", "variant", of=b), F.parse_json(F.lit("{}"))))
        return r.select(
            get("id", of=b).alias("tool_use_id"), "session_id", "folder", "ts", "date", "at", name.alias("name"), mcp.cast("int").alias("is_mcp"), F.when(mcp & (F.size(F.split(name, "__")) >= 3), F.get(F.split(name, "__"), F.lit(1))).alias("mcp_server"),
            F.length(given).alias("input_chars"), F.left(given, F.lit(2000)).alias("input"), path.alias("asked_path"), F.left(command, F.lit(1000)).alias("bash_command"), paths.shell_program(command).alias("bash_program"), "transcript",
        ).where("tool_use_id IS NOT NULL")

    @cached_property
    def tools(self) -> DataFrame:
        results = self._last(self.result_lines.drop("session_id", "folder", "date", "stdout", "agent_type", "resolved_model", "total_tokens", "total_duration_ms", "tool_use_count"), "tool_use_id").drop("at")
        joined = self._last(self.call_lines, "tool_use_id").drop("at").join(results, "tool_use_id", "left")
        file = F.coalesce("asked_path", "result_path")
        wait = F.timestamp_diff("MILLISECOND", F.col("ts"), F.col("result_ts"))
        joined = joined.withColumns({"file_path": file, "file_ext": paths.extension(file), "has_result": F.col("result_ts").isNotNull().cast("int"), "latency_ms": F.when(wait.isNotNull(), F.greatest(wait, F.lit(0)))})
        return self._labelled(joined.drop("asked_path", "result_path")).fillna(0, ["is_error", "interrupted", "lines_added", "lines_removed"])

    @cached_property
    def _said(self) -> DataFrame:
        """User records that hold text rather than tool results."""
        texts = F.filter("blocks", lambda b: get("type", of=b) == "text")
        has_result = F.exists("blocks", lambda b: get("type", of=b) == "tool_result")
        joined = F.array_join(F.transform(texts, lambda b: F.coalesce(get("text", of=b), F.lit(""))), " ")
        said = F.coalesce("plain", F.when(~F.coalesce(has_result, F.lit(True)) & (F.trim(joined) != ""), joined))
        return self.records.where("type = 'user'").withColumn("raw_text", said).where("raw_text IS NOT NULL")

    @cached_property
    def prompts(self) -> DataFrame:
        passed = (F.col("raw_text").startswith("[Request interrupted")) | F.col("raw_text").startswith("This session is being continued from a previous") | F.coalesce(get("isCompactSummary", "boolean"), F.lit(False))
        rows = self._said.where(~passed).select(
            "uuid", "session_id", "folder", "ts", "date", "hour", "dow", "at", "raw_text", "transcript", "is_sidechain", get("promptSource").alias("source"), get("origin.kind").alias("origin_kind"),
            F.coalesce(get("isMeta", "boolean"), F.lit(False)).cast("int").alias("is_meta"), get("entrypoint").alias("entrypoint"),
        )
        return self._labelled(prompts.derived(self._last(rows, "uuid").drop("at")))

    @cached_property
    def events(self) -> DataFrame:
        r = self.records.where("type IN ('system', 'attachment', 'queue-operation')")
        subtype, is_queue = get("subtype"), F.col("type") == "queue-operation"
        kind = F.when(is_queue, "queue").when(F.col("type") == "attachment", "attachment").when(subtype == "compact_boundary", "compact").otherwise("system")
        sub = F.when(is_queue, F.coalesce(get("operation.type"), get("operation"))).when(F.col("type") == "attachment", get("attachment.type")).when(subtype == "compact_boundary", "boundary").otherwise(subtype)
        keep = (F.col("type") != "system") | (F.coalesce(subtype, F.lit("")) != "turn_duration")
        rows = r.where(keep & ((F.col("type") != "attachment") | get("attachment", "variant").isNotNull())).select("uuid", "session_id", "folder", "ts", "date", kind.alias("kind"), sub.alias("subkind"), F.left(get("content"), F.lit(500)).alias("detail"))
        stops = self._said.where(F.col("raw_text").startswith("[Request interrupted")).select("uuid", "session_id", "folder", "ts", "date", F.lit("interrupt").alias("kind"), F.lit("user").alias("subkind"), F.left("raw_text", F.lit(500)).alias("detail"))
        return self._labelled(rows.unionByName(stops))

    @cached_property
    def turns(self) -> DataFrame:
        rows = self.records.where((F.col("type") == "system") & (get("subtype") == "turn_duration"))
        return self._labelled(rows.select("uuid", "session_id", "folder", "ts", "date", get("durationMs", "long").alias("duration_ms"), get("messageCount", "long").alias("message_count")))

    @cached_property
    def subagents(self) -> DataFrame:
        rows = self.result_lines.where("agent_type IS NOT NULL OR resolved_model IS NOT NULL").select("tool_use_id", "session_id", "folder", F.col("result_ts").alias("ts"), "date", "agent_type", "resolved_model", "total_tokens", "total_duration_ms", "tool_use_count", "at")
        return self._labelled(self._last(rows, "tool_use_id").drop("at"))

    @cached_property
    def git(self) -> DataFrame:
        shell = self.result_lines.where("stdout <> ''").select("session_id", "folder", F.col("result_ts").alias("ts"), "date", "stdout", "at", F.col("tool_use_id").alias("id"))
        return git.outcomes(self._labelled(shell), ["at", "id"])

    @cached_property
    def tickets(self) -> DataFrame:
        return git.ticket_evidence(self)

    @cached_property
    def history(self) -> DataFrame:
        """One row for each prompt of the history file; lines that repeat time, session and text count once."""
        rows = parse(self.spark.read.text(f"{self.home}/history.jsonl").withColumn("file", F.lit("history"))).where("v IS NOT NULL")
        shown, ts = F.coalesce(get("display"), F.lit("")), times.parsed(get("timestamp"))
        key = F.sha1(F.concat_ws("|", F.coalesce(get("timestamp"), F.lit("None")), F.coalesce(get("sessionId"), F.lit("None")), shown).cast("binary"))
        pasted = F.coalesce(F.to_json(get("pastedContents", "variant")), F.lit("{}"))
        return rows.select(
            key.alias("key"), ts.alias("ts"), times.day(ts).alias("date"), get("project").alias("project_path"), paths.project_of(get("project"), F.lit(None).cast("string")).alias("project"), get("sessionId").alias("session_id"),
            F.length(shown).alias("chars"), (~pasted.isin("{}", "null", "[]", '""', "false")).cast("int").alias("pasted"), shown.startswith("/").cast("int").alias("is_slash"), F.left(shown, F.lit(300)).alias("preview"),
        ).dropDuplicates(["key"])

    @cached_property
    def folders(self) -> DataFrame:
        """Names of the transcript folders that are still there."""
        return self.lines.select(F.regexp_extract("file", r"/projects/([^/]+)", 1).alias("folder")).distinct()

    @cached_property
    def _cache(self) -> DataFrame:
        return self.spark.read.option("wholetext", "true").text(f"{self.home}/stats-cache.json").select(F.try_parse_json("value").alias("v"))

    @cached_property
    def legacy_days(self) -> DataFrame:
        """Days of the roll-up cache: its activity list joined with its list of tokens by model."""
        each = lambda path: self._cache.select(F.explode(get(path, "array<variant>")).alias("d"))
        number = lambda path: F.coalesce(get(path, "long", of=F.col("d")), F.lit(0))
        activity = each("dailyActivity").select(get("date", of=F.col("d")).alias("date"), number("messageCount").alias("messages"), number("sessionCount").alias("sessions"), number("toolCallCount").alias("tool_calls"))
        by_model = get("tokensByModel", "map<string, double>", of=F.col("d"))
        tokens = each("dailyModelTokens").select(get("date", of=F.col("d")).alias("date"), F.aggregate(F.map_values(by_model), F.lit(0.0), lambda n, x: n + F.coalesce(x, F.lit(0.0))).cast("long").alias("tokens"))
        return activity.join(tokens, "date", "full").where("date IS NOT NULL").fillna(0, ["messages", "sessions", "tool_calls", "tokens"])

    @cached_property
    def legacy_models(self) -> DataFrame:
        rows = self._cache.select(F.explode(get("modelUsage", "map<string, variant>")).alias("model", "u"))
        names = {"input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_read": "cacheReadInputTokens", "cache_write": "cacheCreationInputTokens", "web_searches": "webSearchRequests"}
        return rows.select("model", *[F.coalesce(get(k, "long", of=F.col("u")), F.lit(0)).alias(c) for c, k in names.items()])

    @cached_property
    def legacy_meta(self) -> DataFrame:
        """Totals of the roll-up cache that it has, as JSON: key and value; texts are bare."""
        value = F.col("kv.value")
        plain = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
        rows = self._cache.select(F.explode(F.map_entries(F.try_variant_get("v", "$", "map<string, variant>"))).alias("kv"))
        return rows.where(F.col("kv.key").isin(*CACHE_META)).select(F.col("kv.key").alias("key"), plain.alias("value"))
