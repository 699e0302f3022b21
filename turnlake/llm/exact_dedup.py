"""Exact dedup by recipes of content-defined chunks.

A text is cut where its own content says so: after the first punctuation mark
that follows 256 characters, at 2,048 characters at the latest. Equal texts
thus have equal chunks wherever they stand. Each different chunk is moved once
and its 128-bit identifier is verified: no two different chunks may share one.
Documents are then compared by their ordered lists of identifiers, a few bytes
for each chunk, so that long texts never travel for the comparison.

Only built-in functions run. Groups of copies are counted by partial sums
before the shuffle, and a large group only meets its one summary row in a join
that Spark can split.

Defined results: a null text counts as empty and empty texts are equal; of
equal texts the one with the most code points stays, then the smallest doc_id
(null ids last); rows that repeat a doc_id are counted each, and all rows with
the doc_id that stays are marked kept; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import SPACE, cut, pick, text_of

LEAST, MOST = 256, 2048
#: A chunk ends at punctuation once it is long enough, or where it gets too long.
CHUNK = rf"(?s).{{{LEAST - 1},{MOST - 1}}}?[.,;:!?]|.{{1,{MOST}}}"
#: Seeds to try until no two chunks of the corpus share an identifier; one is enough in practice.
SEEDS = range(0, 64, 2)


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def chunks(text: Column) -> Column:
    """Content-defined chunks of a text, in order; none for an empty one."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column, seed: int) -> Column:
    return F.array(F.xxhash64(F.lit(seed), chunk), F.xxhash64(chunk, F.lit(seed + 1)))


def collisions(docs: DataFrame, seed: int) -> DataFrame:
    """Identifiers that different chunks of ``docs`` (doc_id, text) share; empty if they are verified."""
    pieces = docs.select(F.explode(chunks(normalized(text_of()))).alias("chunk"))
    contents = pieces.select(identifier(F.col("chunk"), seed).alias("id"), "chunk").distinct()
    return contents.groupBy("id").count().where("count > 1")


def recipes(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, code points, digest of the normalised text, and its identifiers in order."""
    return docs.select("doc_id", F.length(text_of()).alias("n_chars"), normalized(text_of()).alias("body")).select(
        "doc_id", "n_chars", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), F.flatten(F.transform(chunks(F.col("body")), lambda c: identifier(c, seed))).alias("recipe")
    )


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    docs = pick(docs, "doc_id", "text")
    seed = next(s for s in SEEDS if not collisions(docs, s).take(1))
    listed = cut(recipes(docs, seed), "recipes")
    first = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))
    # Written, so that the join below deals both sides out anew and Spark can split a large group among tasks.
    groups = cut(listed.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")), "groups")
    return listed.join(groups, "recipe").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("first.doc_id")).alias("kept"), "text_sha256", (F.size("recipe") / 2).cast("int").alias("n_chunks")
    )
