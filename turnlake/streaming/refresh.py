"""Stored tables and roll-ups that follow new lines by the days and sessions they touch.

:func:`refresh` takes the bronze batches since the last time and leaves the
stored tables, ``daily`` and ``session_facts`` as a full run over all lines would
make them. What it works on:

* New lines, and the old lines of files that were rewritten since, touch their
  sessions, and every session that shares a record, a response or a tool call
  with them: a response is billed once wherever its lines are, and a late result
  belongs to a call of some earlier day.
* Those sessions' rows are made again from their records. Records of sessions
  that share something with them are read besides, as what a row counts for may
  depend on them, but their rows stay.
* Days on which a touched session has or had records are written anew, by
  dynamic partition overwrite: rows of other sessions as they are stored, those
  of touched sessions as they are now. ``daily`` is worked out again for just
  these days, ``session_facts`` for just these sessions.

Under the path are, for each load, its records by day, which file, session and
day they belong to (``places``) and what they share (``links``: a 64-bit key, and
the session); then the tables by day, and the progress. The links, some 30 bytes a
line, are the one thing of which every run reads all; all else is read by day.

A run that fails is run again from the same batches: it writes the same loads
over, and a day that was already replaced is replaced by the same rows. Progress
is noted last. The driver gets lists of days and a few counts.

Defined results: lines without a session are one session here, as far as being
touched goes; records without a time are in a day of their own (null); a run
without new batches changes nothing; days that no row is left of go.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.plans import behaviour, usage
from turnlake.sources.scratch import cut
from turnlake.sources.transcripts import Transcripts, get
from turnlake.streaming import ingest

#: Tables by day that roll-ups read. What depends on an order over all sessions (commits, issues) is left to full runs.
TABLES = ("messages", "tools", "prompts", "turns", "events")
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Change:
    """What a run did: the last batch that it took, days written anew (null for none), and how many sessions it worked out again."""

    upto: int
    days: tuple[str | None, ...]
    sessions: int


def _who(name: str = "session_id") -> Column:
    return F.coalesce(name, F.lit("")).alias("who")


def links(records: DataFrame) -> DataFrame:
    """who and key for all that records share with others: their id, their response, the calls that they make or answer."""
    blocks = F.filter(F.coalesce("blocks", F.array().cast("array<variant>")), lambda b: get("type", of=b).isin("tool_use", "tool_result"))
    calls = F.transform(blocks, lambda b: F.concat(F.lit("t"), F.coalesce(get("id", of=b), get("tool_use_id", of=b))))
    response = F.when(F.col("type") == "assistant", F.concat(F.lit("m"), F.coalesce(get("message.id"), get("requestId"))))
    every = F.explode(F.array_compact(F.concat(F.array(F.concat(F.lit("u"), F.col("uuid")), response), calls)))
    return records.select(_who(), every.alias("key")).select("who", F.xxhash64("key").alias("key")).distinct()


class Store:
    """The tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        """Something was written: an empty table leaves a folder without days."""
        where, files = self._files(name)
        return files.exists(where) and any("=" in f.getPath().getName() or f.getPath().getName().endswith(".parquet") for f in files.listStatus(where))

    def _drop(self, name: str, by: str, days: list[str | None]) -> None:
        for day in days:
            where, files = self._files(f"{name}/{by}={day or NO_DAY}")
            files.delete(where, True)

    def read(self, name: str, by: str | None = "date") -> DataFrame | None:
        """A table with its days as texts, or none if nothing was written yet."""
        if not self._has(name):
            return None
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return rows.withColumn(by, F.col(by).cast("string")) if by else rows

    def table(self, name: str) -> DataFrame:
        """A table or roll-up as it stands."""
        rows = self.read(name, "date" if name in TABLES + ("daily",) else "day")
        if rows is None:
            raise ValueError(f"{self.path} has no {name} yet")
        return rows if name in TABLES + ("daily",) else rows.drop("day")

    def progress(self) -> tuple[int, int]:
        """Number of the last load, and the last batch it took; -1 before the first."""
        rows = self.read("progress", None)
        return tuple(rows.agg(F.max("load"), F.max("upto")).first()) if rows is not None else (-1, -1)

    def valid(self, days: list[str | None] | None = None, before: int | None = None, rows: DataFrame | None = None) -> DataFrame | None:
        """Records, of some days only, without those of files that a later load read from their start; ``rows`` are all records, if they were read before."""
        rows = self.read("records") if rows is None else rows
        if rows is None:
            return None
        void = self.read("voids", None)
        if days is not None:
            rows = rows.where(on("date", days))
        if before is not None:
            rows, void = rows.where(F.col("load") < before), void.where(F.col("load") < before)
        last = void.groupBy(F.col("file").alias("__file")).agg(F.max("load").alias("__since"))
        kept = rows.join(last, (F.col("at.file") == F.col("__file")) & (F.col("load") < F.col("__since")), "left_anti")
        return kept

    def replace(self, name: str, rows: DataFrame, sessions: DataFrame, by: str, days: list[str | None]) -> DataFrame:
        """Writes the given days anew: rows of other sessions as they were, of these sessions as given; returns the days' rows."""
        old = self.read(name, by)
        if old is not None:
            kept = old.where(on(by, days)).join(sessions, _who() == sessions.who, "left_anti")
            rows = kept.unionByName(rows)
        return self.put(name, rows, by, days)

    def put(self, name: str, rows: DataFrame, by: str, days: list[str | None]) -> DataFrame:
        staged = cut(rows, name)
        gathered(staged, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{name}")
        left = {r[0] for r in staged.select(by).distinct().collect()}
        self._drop(name, by, [d for d in days if d not in left])
        return staged


def gathered(rows: DataFrame, by: str) -> DataFrame:
    """Rows of a day in one task, so that it writes one file for it.

    Thousands of small days are dealt to all cores: their files take longer to
    make than to fill, and without a number small days would be put into one task.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, by)


def on(by: str, days: list[str | None]) -> Column:
    """The row's day is one of these; they are folded into the scan's partition filter."""
    named = [d for d in days if d is not None]
    some = F.col(by).isin(named) if named else F.lit(False)
    return some | F.col(by).isNull() if None in days else some


def _days(rows: DataFrame, by: str = "date") -> list[str | None]:
    """Different days, of which a log of decades has some thousands."""
    return [r[0] for r in rows.select(by).distinct().collect()]


def refresh(spark: SparkSession, home: str, bronze: DataFrame, path: str) -> Change:
    """Brings the tables under ``path`` up to the last batch of ``bronze`` (value, file, byte_offset, restarted, batch)."""
    store = Store(spark, path)
    load, done = store.progress()
    fresh = bronze.where(F.col("batch") > done)
    upto = fresh.agg(F.max("batch")).first()[0]
    if upto is None:
        return Change(done, (), 0)
    load += 1

    # What came in, and which files start over.
    here = f"load={load}"
    records = Transcripts(spark, home, ingest.current(fresh)).records
    if not records.isEmpty():
        gathered(records, "date").write.mode("overwrite").partitionBy("date").parquet(f"{store.path}/records/{here}")
    elif not store._has("records"):
        return Change(done, (), 0)  # not a record so far; these batches are looked at again with the next
    fresh.where("restarted").select("file").distinct().write.mode("overwrite").parquet(f"{store.path}/voids/{here}")
    # Reading the table lists its days, so it is done once.
    stored_records = store.read("records")
    own = stored_records.where(F.col("load") == load)
    own.select(F.col("at.file").alias("file"), _who(), "date").distinct().write.mode("overwrite").parquet(f"{store.path}/places/{here}")
    links(own).write.mode("overwrite").parquet(f"{store.path}/links/{here}")

    # Sessions that new or voided records belong to, or share something with.
    places, shared = store.read("places"), store.read("links", None)
    new = shared.where(F.col("load") == load).select("who", "key")
    void = store.read("voids", None).where(F.col("load") == load)
    before = places.where(F.col("load") < load).join(void.select("file"), "file")
    gone_days = _days(before)
    touched = own.select(_who())
    if gone_days:
        gone = store.valid(gone_days, load, stored_records).join(void.select(F.col("file").alias("__void")), F.col("at.file") == F.col("__void"), "left_semi")
        gone = cut(gone.select("session_id", "uuid", "type", "v", "blocks"), "gone")
        touched, new = touched.unionByName(gone.select(_who())), new.unionByName(links(gone))
    by_key = shared.select("who", "key").join(new.select("key").distinct(), "key", "left_semi").select("who")
    sessions = cut(touched.unionByName(by_key).distinct(), "touched")
    own_keys = shared.join(sessions, "who", "left_semi").select("key").distinct()
    context = cut(shared.join(own_keys, "key", "left_semi").select("who").unionByName(sessions).distinct(), "context")
    days = _days(places.join(sessions, "who", "left_semi"))

    # Their rows as they are now.
    read = store.valid(_days(places.join(context, "who", "left_semi")), rows=stored_records)
    read = cut(read.join(context, _who() == context.who, "left_semi").drop("load"), "context_records")
    made, rows = Transcripts(spark, home, records=read), {}
    for name in TABLES:
        rows[name] = cut(getattr(made, name).join(sessions, _who() == sessions.who, "left_semi"), f"new_{name}")
    folded = cut(made.sessions.join(sessions, _who() == sessions.who, "left_semi"), "new_sessions")

    # Days and sessions written anew, then what is worked out from them.
    stored = {name: store.replace(name, rows[name], sessions, "date", days) for name in TABLES}
    store.put("daily", usage.daily(SimpleNamespace(messages=stored["messages"], prompts=stored["prompts"])).where(F.col("date").isNotNull()), "date", [d for d in days if d is not None])
    for name, got, day in (("session_facts", behaviour.session_facts(SimpleNamespace(sessions=folded, **rows)), F.left("started", F.lit(10))), ("sessions", folded, F.date_format("first_ts", "yyyy-MM-dd"))):
        got, old = cut(got.withColumn("day", day), name), store.read(name, "day")
        at = _days(got, "day") if old is None else _days(old.join(sessions, _who() == sessions.who, "left_semi").select("day").unionByName(got.select("day")), "day")
        store.replace(name, got, sessions, "day", at)

    n = sessions.count()
    note = spark.sql(f"SELECT CAST({load} AS INT) AS load, CAST({upto} AS BIGINT) AS upto, CAST({len(days)} AS BIGINT) AS days, CAST({n} AS BIGINT) AS sessions")
    note.write.mode("append").parquet(f"{store.path}/progress")
    return Change(upto, tuple(sorted(days, key=lambda d: (d is not None, d))), n)
