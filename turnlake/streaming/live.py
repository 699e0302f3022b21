"""Usage and tool calls while lines come in, in any order, with a state that forgets.

What is counted follows the batch rules: of a response's lines the one with the
smallest uuid is billed, of a line that comes again the later version counts, and
a call has the last of its results. None of this can wait for the last line, so
each query keeps a state for a response or call and emits changes: what a line
now counts for is added, what it counted for before is taken back. Sums of the
changes are at any time what a batch over the lines so far would say, whatever
order they came in; no table is read again, and the output only grows at its end.

``late`` bounds how far behind the newest line a line may arrive (those that are
later are left out), ``kept`` how far apart in time the lines of one response, or
a call and its results, may be. A timer clears the state of a response or call
``kept`` after its newest line, so the state is as large as ``late`` + ``kept``
worth of lines. Within a response, lines are found one by one in a map state; no
response is ever loaded whole.

Defined results: lines without a response or request id are a response each;
calls and results without an id are left out; lines without an id of their own
come before others and are told apart by their place; a line that comes again
belongs to the same response; lines without a time are never late and live as if
they were as new as the newest.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from turnlake.functions import pricing
from turnlake.sources.transcripts import Transcripts

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Counts of a line of which a response's billed one alone is counted, and those of every line.
BILLED, OWN = ("input_tokens", "output_tokens", "cache_write", "cache_read", "writes_5m", "eph_1h"), ("tool_uses",)
#: What a result adds to its call.
FOUND = ("completed", "errors", "interrupted", "lines_added", "lines_removed", "latency_ms")

_LONGS = lambda names: ", ".join(f"{c} long" for c in names)
USAGE_CHANGE = f"date string, session_id string, model string, lines long, api_calls long, {_LONGS(BILLED + OWN)}"
CALL_CHANGE = f"date string, session_id string, name string, calls long, {_LONGS(FOUND)}"
#: Rows by name of those columns.
_UsageChange, _CallChange = (Row(*(field.split()[0] for field in kind.split(", "))) for kind in (USAGE_CHANGE, CALL_CHANGE))
_LINE = f"file string, byte_offset long, date string, session_id string, model string, {_LONGS(BILLED + OWN)}"
_CALL = "file string, byte_offset long, millis long, date string, session_id string, name string"
_RESULT = "file string, byte_offset long, millis long, errors long, interrupted long, lines_added long, lines_removed long"


class Forgetting(StatefulProcessor):
    """A processor whose key is cleared ``kept`` milliseconds after its newest row."""

    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at long")

    def remember(self, newest: int | None, now: int) -> None:
        until = (newest if newest is not None else max(now, 0)) + self.kept
        known = self.until.get()
        if known is None or until > known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.until.update((until,))
            self.handle.registerTimer(until)

    def forget(self) -> None:
        self.until.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


class BilledOnce(Forgetting):
    """Changes of what the lines of one response count for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.billed = handle.getValueState("billed", "id string")
        self.lines = handle.getMapState("lines", "id string", _LINE)

    def forget(self) -> None:
        super().forget()
        self.billed.clear()
        self.lines.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest, found = None, self.billed.get()
        billed = found[0] if found is not None else None
        for row in rows:
            newest = max(row.millis, newest or row.millis) if row.millis is not None else newest
            line = (row.file, row.byte_offset, row.date, row.session_id, row.model, *(row[c] for c in BILLED + OWN))
            before = self.lines.getValue((row.id,)) if self.lines.containsKey((row.id,)) else None
            if before is not None:
                if tuple(before[:2]) >= line[:2]:
                    continue
                yield self._counted(before, -1, billed == row.id, True)
            self.lines.updateValue((row.id,), line)
            if billed is None or row.id < billed:
                if billed is not None:
                    yield self._counted(self.lines.getValue((billed,)), -1, True, False)
                billed = row.id
                self.billed.update((billed,))
            yield self._counted(line, 1, billed == row.id, True)
        self.remember(newest, timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def _counted(line: tuple, sign: int, billed: bool, whole: bool) -> Row:
        """The line added or taken back: what it is billed for, and if ``whole`` the line itself."""
        usage, own = line[5 : 5 + len(BILLED)], line[5 + len(BILLED) :]
        return _UsageChange(*line[2:5], sign if whole else 0, sign if billed else 0, *(sign * x if billed else 0 for x in usage), *(sign * x if whole else 0 for x in own))


class Outcomes(Forgetting):
    """Changes of what one tool call counts for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.call = handle.getValueState("call", _CALL)
        self.result = handle.getValueState("result", _RESULT)

    def forget(self) -> None:
        super().forget()
        self.call.clear()
        self.result.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest, call, result = None, self.call.get(), self.result.get()
        before = self._counted(call, result)
        for row in rows:
            newest = max(row.millis, newest or row.millis) if row.millis is not None else newest
            place = (row.file, row.byte_offset)
            if row.is_call and (call is None or place > tuple(call[:2])):
                call = (*place, row.millis, row.date, row.session_id, row.name)
                self.call.update(call)
            elif not row.is_call and (result is None or place > tuple(result[:2])):
                result = (*place, row.millis, row.errors, row.interrupted, row.lines_added, row.lines_removed)
                self.result.update(result)
        after = self._counted(call, result)
        if after != before:
            if before is not None:
                yield _CallChange(*before[:3], *(-x for x in before[3:]))
            yield _CallChange(*after)
        self.remember(newest, timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def _counted(call: tuple | None, result: tuple | None) -> tuple | None:
        if call is None:
            return None
        if result is None:
            return (*call[3:6], 1, *(0 for _ in FOUND))
        wait = max(0, result[2] - call[2]) if result[2] is not None and call[2] is not None else 0
        return (*call[3:6], 1, 1, *result[3:7], wait)


def session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` that keeps state in RocksDB, as these queries need."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


def _millis(ts: str) -> Column:
    return F.unix_millis(ts).alias("millis")


def _place() -> list[Column]:
    return [F.col("at.file").alias("file"), F.col("at.place.block").alias("byte_offset")]


def usage_changes(lines: DataFrame, late: str = "3 days", kept: int = 7 * 86_400_000) -> DataFrame:
    """Changes of usage by day, session and model (:data:`USAGE_CHANGE`) from streamed lines (value, file, byte_offset)."""
    rows = Transcripts(lines.sparkSession, "", lines).message_lines
    id_ = F.coalesce("uuid", F.concat(F.lit("\0"), F.col("at.file"), F.lit(":"), F.col("at.place.block").cast("string")))
    response = F.coalesce(F.concat(F.lit("k"), F.coalesce("message_id", "request_id")), F.concat(F.lit("u"), id_))
    writes = pricing.five_minute_writes(F.col("cache_write"), F.col("eph_5m"), F.col("eph_1h")).cast("long").alias("writes_5m")
    long = [F.col(c).cast("long").alias(c) for c in BILLED + OWN if c != "writes_5m"]
    picked = rows.select(response.alias("response"), id_.alias("id"), "ts", _millis("ts"), *_place(), "date", "session_id", "model", writes, *long)
    return picked.withWatermark("ts", late).groupBy("response").transformWithState(BilledOnce(kept), USAGE_CHANGE, "Append", "EventTime")


def call_changes(lines: DataFrame, late: str = "3 days", kept: int = 7 * 86_400_000) -> DataFrame:
    """Changes of tool calls by day, session and name (:data:`CALL_CHANGE`) from streamed lines (value, file, byte_offset)."""
    model = Transcripts(lines.sparkSession, "", lines)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    said = ("errors", "interrupted", "lines_added", "lines_removed")
    calls = model.call_lines.select("tool_use_id", F.lit(True).alias("is_call"), "ts", _millis("ts"), *_place(), "date", "session_id", "name", *none("long", *said))
    results = model.result_lines.select(
        "tool_use_id", F.lit(False).alias("is_call"), F.col("result_ts").alias("ts"), _millis("result_ts"), *_place(), *none("string", "date", "session_id", "name"),
        F.col("is_error").cast("long").alias("errors"), *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in said[1:]],
    )
    return calls.unionByName(results).withWatermark("ts", late).groupBy("tool_use_id").transformWithState(Outcomes(kept), CALL_CHANGE, "Append", "EventTime")


def start(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the changes of all lines that are there to Parquet files under ``out``, each once, and stops."""
    return changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def usage(changes: DataFrame, *by: str) -> DataFrame:
    """Usage summed up ``by`` columns, priced by model; groups of which nothing is left go."""
    sums = [F.sum(c).alias(c) for c in ("lines", "api_calls", *BILLED, *OWN)]
    once = changes.groupBy("date", "session_id", "model").agg(*sums).where("lines > 0")
    cost = pricing.cost(F.col("price_in"), F.col("price_out"), F.col("input_tokens"), F.col("output_tokens"), F.col("writes_5m"), F.col("eph_1h"), F.col("cache_read"))
    priced = pricing.with_rates(once).withColumn("cost_usd", cost)
    total = F.sum(F.expr("input_tokens + output_tokens + cache_write + cache_read")).alias("total_tokens")
    return priced.groupBy(*by).agg(
        F.sum("api_calls").alias("api_calls"), F.count_distinct("session_id").alias("sessions"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_write", "cache_read")], total,
        F.expr("CAST(round(CAST(sum(cost_usd) AS DECIMAL(28, 10)), 4) AS DOUBLE)").alias("cost_usd"), F.sum("tool_uses").alias("tool_uses"),
    )


def calls(changes: DataFrame, *by: str) -> DataFrame:
    """Tool calls summed up ``by`` columns; groups of which nothing is left go."""
    return changes.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("calls", *FOUND)]).where("calls > 0")
