"""Appends new transcript lines to a bronze table, by a stream of local files or by batches from any file system; all else is views over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnlake.sources import appended, scratch, tail
from turnlake.sources.transcripts import Transcripts


def start(spark: SparkSession, home: str, bronze: str, checkpoint: str) -> StreamingQuery:
    """Reads what is new under ``home``/projects once and stops; offsets stay in ``checkpoint``.

    A batch that is run again after a failure writes to the same folder, so
    lines are neither lost nor repeated.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{bronze}/batch={number}")

    return tail.stream(spark, f"{home}/projects").writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(spark: SparkSession, home: str, bronze: str) -> int:
    """Appends what is new under ``home``/projects to ``bronze`` as one batch, by Spark's file source on any file system; returns its number, or -1 if nothing changed.

    What was taken of each file is in a table beside, which is written last: a
    run that failed before is repeated under the same number.
    """
    beside = f"{bronze.rstrip('/')}-files"
    schema = f"{appended.STATE}, batch long"
    rows = spark.read.schema(schema).parquet(beside) if scratch.exists(spark, beside) else spark.createDataFrame([], schema)
    last = rows.agg(F.max("batch")).first()[0]
    state = rows.groupBy("file").agg(F.max_by(F.struct("size", "changed", "taken", "first", "last"), "batch").alias("s")).select("file", "s.*")
    found = appended.new_lines(spark, f"{home.rstrip('/')}/projects", state)
    if found is None:
        return -1
    lines, after = found
    number = 0 if last is None else last + 1
    lines.write.mode("overwrite").parquet(f"{bronze}/batch={number}")
    after.write.mode("overwrite").parquet(f"{beside}/batch={number}")
    return number


def current(bronze: DataFrame) -> DataFrame:
    """The lines of ``bronze`` that are in their files now: those since a file was last read from its start."""
    since = bronze.where("restarted").groupBy(F.col("file").alias("of")).agg(F.max("batch").alias("since"))
    return bronze.join(since, bronze.file == since.of, "left").where((F.col("batch") >= F.coalesce("since", F.lit(0))) & F.col("value").isNotNull()).select("value", "file", "byte_offset")


def model(spark: SparkSession, home: str, bronze: str) -> Transcripts:
    """Model tables over the bronze lines; a file that was rewritten counts as it is now."""
    return Transcripts(spark, home, current(spark.read.parquet(bronze)))
