"""Periodic runs of words in documents: found, and collapsed to their first period.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal), at least ``min_length`` and 2 * q words long, that no neighbouring
word extends. Runs depend on one document only, so documents are spread over
tasks as they come, without a shuffle, and each batch is worked on as a whole:

* Only stretches of words that all lie in some ``gram`` of words that occurs
  again in the document can hold a run (see :func:`stretches`), so others are
  left out. Texts that repeat themselves throughout stay whole. Each stretch is
  a string of its own, with symbols of its own, in one long string.
* The suffix array comes by doubling; ranks of each doubling are kept, as they
  answer longest common extensions to either side (LCP) for whole arrays.
* The longest previous factor of each place is the larger LCP with its nearest
  earlier places above and below in the suffix array. It cuts the string into
  LZ blocks: as long as possible, each one has an earlier copy.
* Runs that touch a block's border are found by Main's extensions: for each
  period up to the lengths of the blocks beside it, the extensions to left and
  right around the border, or the one a period away, tell a run. A run that
  starts before the block before the last border reached in it does so by less
  than a period, as that block would else go on; this bounds the periods, and the
  extensions of all borders are in proportion to the words.
* All others lie inside a block and are copies of runs in the block's source.
  They are taken in buckets by start, from left to right.

Time is n log n in a document's words, memory 4 bytes for each word and doubling
of a slice of SLICE words or of one text.

Defined results: null and empty texts have no words and no runs; null and
repeated doc_ids are rows like others; an empty table gives an empty result;
extra columns are left aside whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import SPACE, pick, pieces, text_of
from turnlake.llm.word_hashes import WordHashes, mixed
from turnlake.llm.word_hashes import runs as run_hashes

#: Words of the shortest run, unless asked otherwise.
LEAST = 12
#: Words that are worked on at a time, but for one text of more.
SLICE = 100_000

Run = tuple[int, int, int]


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of many ranges of n numbers from ``first``: the range's number, and the numbers, one after the other."""
    of = np.repeat(np.arange(len(n)), n)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def stretches(hashes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First word and word behind the last of each stretch that may hold runs.

    In a run of L words and period q a gram of g words is repeated q words on,
    or before, if L >= g + q; and those at most L - g - q and those from q on
    cover all its words. As L is at least ``least`` and 2 * q, g may be half of
    ``least`` + 1.
    """
    g, n = (least + 1) // 2, np.diff(bounds)
    k = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
    at = np.flatnonzero(k + g <= np.repeat(n, n))
    of = np.searchsorted(bounds, at, "right") - 1
    key = mixed(run_hashes(hashes, at, at + g) ^ mixed(of.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(at) else at
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[again] += 1
    cover[again + g] -= 1
    inside = np.cumsum(cover)[:-1] > 0
    new = np.zeros(len(hashes) + 1, bool)
    new[bounds] = True
    new[1:-1] |= inside[1:] != inside[:-1]
    edge = np.flatnonzero(new)
    first, behind = edge[:-1], edge[1:]
    keep = inside[first] & (behind - first >= least) if len(first) else np.zeros(0, bool)
    return first[keep], behind[keep]


def doubled(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their next 1, 2, 4, ... symbols, until all differ; the last symbol occurs once."""
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
    width, n = 1, len(symbols)
    while ranks[-1].max(initial=-1) < n - 1:
        key = ranks[-1].astype(np.int64) * (n + 1)
        key[:-width] += ranks[-1][width:] + 1
        order = np.argsort(key)
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        ranks.append(rank)
        width *= 2
    return ranks


def ahead(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of what is equal from places i and j (never the same) on."""
    i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        step = (ranks[k][i] == ranks[k][j]).astype(np.int64) << k
        i, j, n = i + step, j + step, n + step
    return n


def before(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of what is equal before places i < j."""
    n = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        a, b = i - n - (1 << k), j - n - (1 << k)
        n += ((a >= 0) & (ranks[k][np.maximum(a, 0)] == ranks[k][np.maximum(b, 0)])).astype(np.int64) << k
    return n


def previous_factors(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest factor at each place that begins earlier, too, and where; 0 and any place if there is none."""
    n = len(ranks[-1])
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    above, below, open_ = [-1] * n, [-1] * n, []
    for p in order.tolist():
        while open_ and open_[-1] > p:
            below[open_.pop()] = p
        if open_:
            above[p] = open_[-1]
        open_.append(p)
    place = np.arange(n)
    lengths = []
    for earlier in (np.array(above, np.int64), np.array(below, np.int64)):
        some = np.flatnonzero(earlier >= 0)
        length = np.zeros(n, np.int64)
        length[some] = ahead(ranks, place[some], earlier[some])
        lengths.append((length, earlier))
    (up, at_up), (down, at_down) = lengths
    return np.maximum(up, down), np.where(up >= down, at_up, at_down)


def blocks(factors: np.ndarray) -> np.ndarray:
    """Where LZ blocks begin, and the end."""
    step, at, out = np.maximum(factors, 1).tolist(), 0, []
    while at < len(step):
        out.append(at)
        at += step[at]
    return np.array([*out, len(step)], np.int64)


def at_borders(symbols: np.ndarray, ranks: list[np.ndarray], starts: np.ndarray, least: int) -> np.ndarray:
    """Start, length and period of each run that touches a border between blocks; periods may be multiples of the smallest."""
    border, n = starts[1:-1], np.diff(starts)
    before_it, behind_it = n[:-1], n[1:]
    # The period's pair of places: the border and a place to its left, or to its right.
    of, p = _spread(np.ones(len(border), np.int64), np.minimum(before_it + behind_it - 1, border))
    of2, p2 = _spread(np.ones(len(border), np.int64), np.minimum(behind_it, len(symbols) - 1 - border))
    x = np.concatenate((border[of] - p, border[of2]))
    p = np.concatenate((p, p2))
    near = (symbols[x] == symbols[x + p]) | ((x > 0) & (symbols[x - 1] == symbols[x + p - 1]))
    x, p = x[near], p[near]
    left, right = before(ranks, x, x + p), ahead(ranks, x, x + p)
    run = (left + right >= p) & (left + right + p >= least)
    return np.stack((x - left, left + right + p, p), 1)[run]


def copied(found: list[Run], starts: np.ndarray, factors: np.ndarray, sources: np.ndarray, least: int) -> list[Run]:
    """All runs: those found at borders, and their copies inside of later blocks."""
    at: dict[int, dict[int, int]] = {}
    for start, length, period in found:
        of = at.setdefault(start, {})
        of[length] = min(period, of.get(length, period))
    order = sorted(at)
    long = np.flatnonzero((np.diff(starts) >= least + 2) & (factors[starts[:-1]] > 0))
    for b, n, s in zip(starts[long].tolist(), factors[starts[long]].tolist(), sources[starts[long]].tolist()):
        k = bisect_right(order, s)
        while k < len(order) and order[k] + least < s + n:
            here = order[k]
            for length, period in list(at[here].items()):
                if here + length < s + n:
                    there = here + b - s
                    if there not in at:
                        order.insert(bisect_left(order, there), there)
                    at.setdefault(there, {}).setdefault(length, period)
            k += 1
    return [(start, length, period) for start, of in at.items() for length, period in of.items()]


def runs_of(words: list[bytes], bounds: np.ndarray, known: dict, least: int = LEAST) -> list[Run]:
    """Start, length and period of each run in many texts' words, sorted; ``bounds`` is where texts begin, and the end."""
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    first, behind = stretches(hashes, bounds, least)
    if not len(first):
        return []
    of, place = _spread(first, behind - first)
    ids: dict[bytes, int] = {}
    told = np.array([ids.setdefault(words[p], len(ids)) for p in place.tolist()], np.int64)
    # A symbol is a word of one stretch; behind each stretch stands one of its own.
    ends = np.cumsum(behind - first)
    symbols = np.insert(told + of * (len(ids) + 1), ends, np.arange(len(first)) * (len(ids) + 1) + len(ids))
    places = np.insert(place, ends, -1)
    ranks = doubled(symbols)
    factors, sources = previous_factors(ranks)
    starts = blocks(factors)
    found = copied(at_borders(symbols, ranks, starts, least).tolist(), starts, factors, sources, least)
    return sorted((int(places[start]), length, period) for start, length, period in found)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that are in a run behind its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def found_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """For each document: doc_id, n_words, its runs (start, length and period, by start, then period) and its collapsed text, words joined by one space."""
    rows = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def done(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            found = runs_of([w for t in texts for w in t], bounds, known, least)
            of = np.searchsorted(bounds, [r[0] for r in found], "right") - 1 if found else np.zeros(0, np.int64)
            own: list[list[Run]] = [[] for _ in texts]
            for k, (start, length, period) in zip(of.tolist(), found):
                own[k].append((start - int(bounds[k]), length, period))
            lists = [[{"start": s, "length": n, "period": p} for s, n, p in sorted(r, key=lambda x: (x[0], x[2]))] for r in own]
            kept = [b" ".join(collapsed(t, r)).decode() for t, r in zip(texts, own)]
            return pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(lists, pa.list_(_RUN)), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            ids, texts, begun, n = batch.column("doc_id"), [], 0, 0
            for k, text in enumerate(batch.column("text")):
                # ``bytes`` splits at just the white space of the contracts.
                texts.append(text.as_py().encode().split())
                n += len(texts[-1])
                if n >= SLICE:
                    yield done(ids.slice(begun, len(texts)), texts)
                    texts, begun, n = [], k + 1, 0
            if texts:
                yield done(ids.slice(begun, len(texts)), texts)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """For each document: doc_id, n_words, n_runs, the longest run (start, length, period, exponent_milli; of equal ones the first) and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(told, "\n"), F.lit("\n"))).otherwise("")
    rows = found_runs(docs, least).withColumn("longest", longest)
    return rows.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.back")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.less")).alias("period"),
        F.expr("(1000 * longest.length) div (-longest.less)").alias("exponent_milli"), _sha256(told).alias("runs_sha256"), _sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: Planted cycles are repeated at least 3 times, and less than 3 + MOST_TIMES.
MOST_TIMES = 8


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one in ten texts, chosen by a checksum of doc_id, repeats a stretch of its words from some place on.

    Of h = crc32(doc_id in decimal digits) and g = floor(h / 10), texts with
    h % 10 = 0 and n > 0 words have from a = g % n on the words a + (i - a) % p,
    with p = 1 + floor((n - a) / (3 + g % 8)). Texts without doc_id stay.
    """
    words, h = pieces(text_of(), f"[{SPACE}]+"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % MOST_TIMES))).cast("int")
    # What is left of the text is less than 2 + MOST_TIMES cycles.
    cycles = F.flatten(F.array_repeat(F.slice(words, a + 1, p), 2 + MOST_TIMES))
    again = F.slice(F.concat(F.slice(words, F.lit(1), a), cycles), F.lit(1), n.cast("int"))
    rows = pick(docs, "doc_id", "text")
    return rows.select("doc_id", F.when((h % 10 == 0) & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
