"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item, or a shorter item whole.
A text that holds a window holds all of its words, so it is enough to look
where its rarest word stands: words are ordered by how often the corpus has
them, and of each window only the necessary prefix of that order, its first
word, is joined with the words of the documents. Where that word matches, its
place in the window fixes where the window would start; starts before the text,
or too near its end, are dropped (positional and length bounds). What is left
is verified word by word against the words around the match.

Only built-in functions run. A Bloom filter that every executor has drops the
words of documents that can't match before anything is shuffled: once for the
counts, of which each task sends one row for each word of the benchmark, and
once for the join, which thus meets only places of windows' rarest words, with
the few words around them. Texts don't move. Both sides of that join are tables
in files, so that Spark can split a word that many documents have.

Defined results: null and empty texts have no words and are clean; items
without words never match; repeated items count once for each different
item_id, null ids not at all; rows that repeat a doc_id, null or not, are judged
each by its own text; empty tables give an empty result or clean documents;
other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import carried, cut, fitting, lower_ascii, pick, pieces, restored, text_of
from turnlake.operators import bloom

#: What separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a window.
WINDOW = 13
#: A document is contaminated if at least one word of this many is hit.
PER_HIT = 20


def words(text: Column) -> Column:
    return pieces(lower_ascii(text), BETWEEN)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and words of every window of ``items`` (item_id, text); repeats within an item once."""
    w = F.col("w")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    found = items.select("item_id", words(text_of()).alias("w")).where(F.size("w") > 0)
    return found.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(w, s, size))).alias("words")).distinct()


def _said(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``word`` may be in the column word of ``keys``, which is in files."""
    n = keys.count()
    return bloom.possible(rows, F.xxhash64("word"), bloom.built(keys.select(F.xxhash64("word")), n), n)


def prefixes(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """word, window, place and words: each window of ``distinct`` (window, a number, and words) with its rarest word and where in it that stands.

    How rare a word is counts all of ``docs``; windows of which no document has
    the rarest word are left out.
    """
    placed = distinct.select("window", F.posexplode("words").alias("place", "word"))
    vocabulary = cut(placed.select("word").distinct(), "vocabulary")
    said = _said(docs.select(F.explode(words(text_of())).alias("word")), vocabulary)
    often = cut(said.groupBy("word").agg(F.count(F.lit(1)).alias("often")), "often")
    ranked = placed.join(fitting(often), "word", "left").select("window", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word", "place").alias("first"))
    rarest = ranked.groupBy("window").agg(F.min("first").alias("first")).where("first.often > 0")
    return cut(rarest.select("window", "first.word", "first.place").join(distinct, "window"), "prefixes")


def found_in(docs: DataFrame, prefix: DataFrame, size: int) -> DataFrame:
    """doc_id, version (the text's hash), n (its words), start (from 0), length and window of every occurrence of a window in ``docs``."""
    w = docs.select("doc_id", F.xxhash64(text_of()).alias("version"), words(text_of()).alias("w"))
    said = w.select("doc_id", "version", F.size("w").alias("n"), "w", F.posexplode("w").alias("at", "word"))
    lead = F.least("at", F.lit(size - 1))
    near = _said(said, prefix.select("word")).select("doc_id", "version", "n", "at", "word", lead.alias("lead"), F.slice("w", F.col("at") - lead + 1, lead + size).alias("near"))
    start, length = F.col("at") - F.col("place"), F.size("words")
    met = near.join(fitting(prefix), "word").where((start >= 0) & (start + length <= F.col("n")))
    same = F.slice("near", F.greatest(F.col("lead") - F.col("place") + 1, F.lit(1)), length) == F.col("words")
    return met.where(same).select("doc_id", "version", "n", start.alias("start"), length.alias("length"), "window").distinct()


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``docs`` (doc_id, text) have of ``items``, for texts that have something.

    The first table has of_doc, of_version, n_words and n_hit; the second
    of_doc, of_version and window (a number); the third window and item_id.
    """
    # The distinct windows with their numbers are written once, so that every branch sees the same numbers.
    of_items = windows(pick(items, "item_id", "text"), size)
    distinct = cut(of_items.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"), "windows")
    found = cut(found_in(docs, prefixes(distinct, docs.select("text")), size).withColumnsRenamed({"doc_id": "of_doc", "version": "of_version"}), "found")
    text = ("of_doc", "of_version")
    spots = found.select(*text, "n", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("spot")).distinct()
    counts = spots.groupBy(*text).agg(F.max("n").cast("long").alias("n_words"), F.count(F.lit(1)).alias("n_hit"))
    return counts, found.select(*text, "window").distinct(), of_items.join(distinct, "words").select("window", "item_id")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (PER_HIT * n_hit >= n_words)


def _own(docs: DataFrame, other: DataFrame) -> Column:
    """Condition that a row of ``other`` is of the text of a row of ``docs``."""
    return docs.doc_id.eqNullSafe(other.of_doc) & (F.xxhash64(text_of()) == other.of_version)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = pick(docs, "doc_id", "text")
    counts, at, of_items = hits(docs, items)
    named = at.join(of_items, "window").where("item_id is not null").select("of_doc", "of_version", F.col("item_id").cast("string").alias("item")).distinct()
    listed = named.groupBy("of_doc", "of_version").agg(F.sort_array(F.collect_list("item")).alias("items")).withColumnsRenamed({"of_doc": "o", "of_version": "v"})
    # Written, so that the join with the documents deals both sides out anew.
    per = cut(counts.join(listed, F.col("of_doc").eqNullSafe(F.col("o")) & (F.col("of_version") == F.col("v")), "left").drop("o", "v"), "hits")
    rows = docs.join(fitting(per.drop("n_words")), _own(docs, per), "left").select("doc_id", F.size(words(text_of())).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    rows = carried(docs, docs.columns, "doc_id", "text")
    counts = hits(rows.select("doc_id", "text"), items)[0]
    bad = cut(counts.where(contaminated(F.col("n_hit"), F.col("n_words"))).select("of_doc", "of_version"), "contaminated")
    return rows.join(fitting(bad), _own(rows, bad), "left_anti").select(*restored(docs.columns, "doc_id", "text"))
