"""New lines of files that grow, by Spark's own text source, on any file system it reaches.

Files are listed with size and time of change (no content is read for that) and
compared with a table of what was taken of each: its bytes, and hashes of its
first and of its last line taken. Only files that changed are read, whole, as a
file source can't begin in the middle; of these, lines behind what was taken are
new. A file whose first line, or whose line ending there, is another one was
rewritten and is taken from its start, with a row without a value besides, so
that readers learn of it even if the file has no lines any more.

A line's place is the sum of the lengths of all lines before it: along the lines
of each part of a file that a task reads, plus the lengths of the parts before,
of which a file has one for each 128 MB or so. Nothing of this is on the driver
but the time of the oldest change.

Defined results: lines end with a line feed, the last one waits for its own;
blank lines are left out; what is written to a file after it was listed comes the
next time; files that are gone keep their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.sources.scratch import cut

STATE = "file string, size long, changed timestamp, taken long, first long, last long"


def listed(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, size and time of change of all files under ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"))


def _placed(lines: DataFrame) -> DataFrame:
    """Lines (file, block, k, value) with the byte at which each begins, and the one behind its line feed."""
    length = F.octet_length("value").cast("long") + 1
    along = Window.partitionBy("file", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = lines.groupBy("file", "block").agg(F.sum(length).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    upto = F.sum(length).over(along)
    return lines.withColumns({"upto": upto, "length": length}).join(base, ["file", "block"]).withColumns({"end": F.col("base") + F.col("upto"), "byte_offset": F.col("base") + F.col("upto") - F.col("length")})


def _hash(value: str = "value") -> Column:
    return F.xxhash64(value)


def new_lines(spark: SparkSession, path: str, state: DataFrame | None, glob: str = "*.jsonl") -> tuple[DataFrame, DataFrame] | None:
    """What came since ``state`` (STATE, one row a file): lines (value, file, byte_offset, restarted), and the state of the files that changed; none if none did."""
    known = (state if state is not None else spark.createDataFrame([], STATE)).select("file", F.col("size").alias("was"), F.col("changed").alias("then"), "taken", F.col("first").alias("old_first"), F.col("last").alias("old_last"))
    moved = listed(spark, path, glob).join(known, "file", "left").where("was IS NULL OR was <> size OR then <> changed")
    moved = cut(moved.withColumn("taken", F.coalesce("taken", F.lit(0))).drop("was", "then"), "moved")
    oldest = moved.agg(F.min("changed")).first()[0]
    if oldest is None:
        return None
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    # Files that changed no later than the oldest change aren't opened.
    read = read.where(F.col("_metadata.file_modification_time") >= F.lit(oldest))
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value")
    lines = cut(_placed(lines.join(moved.select("file"), "file", "left_semi")).join(moved, "file").where("end <= size"), "appended")
    # A file goes on where it was left if the lines that tell are the same.
    told = lines.groupBy("file").agg(
        F.min_by(_hash(), "end").alias("first"), F.max_by(_hash(), "end").alias("last"), F.max("end").alias("upto"), F.max(F.when((F.col("end") == F.col("taken")) & (_hash() == F.col("old_last")), 1).otherwise(0)).alias("reached")
    )
    files = moved.join(told, "file", "left").withColumn("same", (F.col("taken") > 0) & F.coalesce((F.col("reached") == 1) & (F.col("first") == F.col("old_first")), F.lit(False)))
    files = cut(files, "changed-files")
    fresh = lines.join(files.select("file", "same"), "file").where("(NOT same OR byte_offset >= taken)").where(F.col("value").rlike(r"\S"))
    fresh = fresh.select(F.rtrim("value", F.lit("\r")).alias("value"), "file", "byte_offset", (~F.col("same")).alias("restarted"))
    rewritten = files.where("taken > 0 AND NOT same").select(F.lit(None).cast("string").alias("value"), "file", F.lit(-1).cast("long").alias("byte_offset"), F.lit(True).alias("restarted"))
    after = files.select("file", "size", "changed", F.coalesce("upto", F.lit(0)).alias("taken"), "first", "last")
    return fresh.unionByName(rewritten), after
