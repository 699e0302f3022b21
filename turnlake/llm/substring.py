"""Substring dedup: seed and extend over winnowed anchors.

A window is WINDOW consecutive words. A word goes if a window that covers it
also starts in a document with a smaller doc_id; windows are those of the input.

Seeds: of the HALF-word runs that a window holds, the one with the least hash is
its anchor. Equal windows thus have equal anchors, and about one word in
thirteen begins one. All windows with one anchor are neighbours; their union is
the anchor's context, the anchor extended to the left and right as far as any
window that it answers for. Each window belongs to one seed.

Extend: seeds are joined on their anchors, not in pairs but in classes. Seeds
with equal contexts match over all of it, so what stands in a later document
than the first of the class is a repeat from end to end. That takes in copies
and the inside of passages, whatever their number. Where an anchor has several
contexts, documents part somewhere left or right of it (a passage's borders).
There the seeds in the first document of each class are extended word by word:
each step is one window, told by its hash, and the least doc_id of each hash
tells how far some earlier document agrees. Steps that adjoin or overlap are
merged, also those of neighbouring seeds, so what comes out are maximal repeats
of at least WINDOW words. No pair of documents is ever made, and a window is
looked at once for each class.

Anchors that one document alone has are told by a Bloom filter of all others and
go first. Hot anchors, classes and windows are counted with partial sums and meet their
one summary row in joins that Spark can split. One document's seeds and spans
are the most that is gathered in one place. Equal hashes (128 bits) are taken as
equal words.

Defined results: null and empty texts and those of fewer than WINDOW words stay
as they are; null doc_ids come first, and rows with equal doc_ids take nothing
from each other; rows that repeat both doc_id and text are treated alike; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm import line_windows
from turnlake.llm.common import SPACE, carried, cut, pieces, restored, text_of, word_count
from turnlake.llm.word_hashes import WordHashes, hashed_runs, least, runs
from turnlake.operators import bloom

#: Words in a window, and in the runs that may be its anchor.
WINDOW, HALF = 50, 25
#: Texts that are handled at a time.
TEXTS = 200


def word_hashes(texts: list[str], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts, and where each text begins, and the end."""
    words, bounds = array("Q"), [0]
    for text in texts:
        # ``bytes`` splits at just the white space of the contracts.
        words.extend(map(known.__getitem__, text.encode().split()))
        bounds.append(len(words))
    return np.array(words, np.uint64), np.array(bounds, np.int64)


def seeds_of(hashes: np.ndarray, bounds: np.ndarray, window: int = WINDOW, half: int = HALF) -> tuple[np.ndarray, ...]:
    """First word and word behind the last of each seed's context, and the hash of its anchor."""
    n = np.diff(bounds)
    if n.max(initial=0) < window:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    at = np.arange(len(hashes) - half + 1)
    grams = runs(hashes, at, at + half)
    k = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
    start = np.flatnonzero(k + window <= np.repeat(n, n))
    anchor = least(grams >> np.uint64(32), window - half + 1)[start]
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    end = np.concatenate((new[1:], [True]))
    return start[new], start[end] + window, grams[anchor[new]]


def seeds(docs: DataFrame, window: int = WINDOW, half: int = HALF) -> DataFrame:
    """doc_id, text's hash, first word, word behind the last, anchor and hash of the context of every seed."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("version"), text_of().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                hashes, bounds = word_hashes(part.column("text").to_pylist(), known)
                first, behind, anchor = seeds_of(hashes, bounds, window, half)
                _, _, h1, h2 = hashed_runs(hashes, first, behind)
                of = np.searchsorted(bounds, first, "right") - 1
                numbers = [pa.array((x - bounds[of]).astype(np.int32)) for x in (first, behind)] + [pa.array(x.view(np.int64)) for x in (anchor, h1, h2)]
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(of)) for c in ("doc_id", "version")] + numbers, ["doc_id", "version", "first", "behind", "anchor", "h1", "h2"])

    return rows.mapInArrow(each, f"doc_id {kind}, version long, first int, behind int, anchor long, h1 long, h2 long")


def _who() -> list[Column]:
    """Of a group: the least and greatest doc_id, and whether there is a null, which comes before all."""
    return [F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("unnamed")]


def _several() -> Column:
    """The group is of more than one doc_id."""
    return (F.col("low") != F.col("high")) | (F.col("unnamed") & F.col("high").isNotNull())


def _later() -> Column:
    """The row's document comes after the first of the group it is joined with."""
    return F.when(F.col("unnamed"), F.col("doc_id").isNotNull()).otherwise(F.col("doc_id") > F.col("low"))


def windows(docs: DataFrame, wanted: DataFrame, window: int = WINDOW, half: int = HALF) -> DataFrame:
    """doc_id, text's hash, first word and hash of each window of the seeds ``wanted`` (doc_id, version, first), and of a few others.

    Texts are read again where they lie: shuffling them to their seeds would cost
    more than hashing the windows of all seeds, most of which a Bloom filter drops.
    """
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("version"), text_of().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                hashes, bounds = word_hashes(part.column("text").to_pylist(), known)
                first, behind, _ = seeds_of(hashes, bounds, window, half)
                n = behind - first - window + 1
                start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                _, _, h1, h2 = hashed_runs(hashes, start, start + window)
                of, edges = np.searchsorted(bounds, first, "right") - 1, pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                columns = [part.column(c).take(pa.array(of)) for c in ("doc_id", "version")] + [pa.array((first - bounds[of]).astype(np.int32))]
                columns += [pa.ListArray.from_arrays(edges, pa.array(h.view(np.int64))) for h in (h1, h2)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "first", "h1", "h2"])

    key, n = F.xxhash64("doc_id", "version", "first"), wanted.count()
    of_seeds = rows.mapInArrow(each, f"doc_id {kind}, version long, first int, h1 array<long>, h2 array<long>")
    some = bloom.possible(of_seeds, key, bloom.built(wanted.select(key), n), n)
    return some.select("doc_id", "version", "first", F.posexplode(F.arrays_zip("h1", "h2")).alias("k", "h")).select("doc_id", "version", (F.col("first") + F.col("k")).alias("first"), "h.h1", "h.h2")


def _by_document(spans: DataFrame) -> DataFrame:
    """The spans of each document in one array: first word, word behind the last, in turn."""
    return spans.groupBy(F.col("doc_id").alias("of_doc"), F.col("version").alias("of_version")).agg(F.flatten(F.collect_set(F.array("first", "behind"))).alias("gone"))


def repeats(docs: DataFrame, window: int = WINDOW, half: int = HALF) -> DataFrame:
    """doc_id, version (the text's hash), first word and word behind the last of spans that earlier documents have, too; they overlap."""
    found = cut(seeds(docs, window, half), "seeds")
    # Anchors of one document alone, most of them, go before anything else is shuffled.
    met_again = cut(found.groupBy("anchor").agg(*_who()).where(_several()).select("anchor"), "anchors")
    n, key = met_again.count(), F.xxhash64("anchor")
    some = bloom.possible(found, key, bloom.built(met_again.select(key), n), n)
    classes = cut(some.groupBy("anchor", "h1", "h2").agg(*_who()), "classes")
    again = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("unnamed").alias("unnamed"))
    # Written, so that the join's other side comes straight from its shuffle and Spark can split hot anchors.
    parted = cut(again.where(_several() & (F.col("n") > 1)).select("anchor", F.lit(True).alias("parted")), "parted")
    shared = classes.join(parted.hint("merge"), "anchor", "left").withColumn("parted", F.coalesce("parted", F.lit(False))).where(_several() | F.col("parted"))
    met = cut(some.drop("anchor").join(shared.select("h1", "h2", "low", "unnamed", "parted").hint("merge"), ["h1", "h2"]).select("doc_id", "version", "first", "behind", _later().alias("later"), "parted"), "met")
    whole = met.where("later").select("doc_id", "version", "first", "behind")
    # Windows of the first documents of classes: all others have the same ones, and later.
    steps = cut(windows(docs, met.where("parted AND NOT later").select("doc_id", "version", "first"), window, half), "steps")
    known = cut(steps.groupBy("h1", "h2").agg(*_who()).where(_several()).select("h1", "h2", "low", "unnamed"), "known")
    matched = steps.join(known.hint("merge"), ["h1", "h2"]).where(_later())
    return whole.unionByName(matched.select("doc_id", "version", "first", (F.col("first") + window).alias("behind")))


def dedup(docs: DataFrame, carry: Sequence[str] = (), window: int = WINDOW, half: int = HALF) -> DataFrame:
    """doc_id and text without repeated words, what :func:`carried` makes of ``carry``, n_removed and removed (the maximal repeats, words from 0: first-behind, comma-joined)."""
    docs = carried(docs, carry, "doc_id", "text")
    return line_windows.removed(docs, _by_document(repeats(docs.select("doc_id", "text"), window, half)))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with their columns, repeated words cut out of text; n_chars, where there is one, follows."""
    rows, kinds = dedup(docs, docs.columns), dict(docs.dtypes)
    return rows.select(*[F.when(F.col("n_removed") > 0, F.length("text").cast(kinds[c])).otherwise(x).alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, restored(docs.columns, "doc_id", "text"))])


def report(docs: DataFrame) -> DataFrame:
    """For each document: doc_id, n_words, n_removed, removed, and kept_sha256 of the words that stay, space-joined."""
    left = F.array_join(pieces(text_of(), f"[{SPACE}]+"), " ")
    return dedup(docs).select("doc_id", (word_count(text_of()) + F.col("n_removed")).alias("n_words"), "n_removed", "removed", F.sha2(left.cast("binary"), 256).alias("kept_sha256"))
