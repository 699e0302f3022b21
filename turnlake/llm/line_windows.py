"""Line dedup by overlapping windows of three lines, and of words in long lines.

Each three consecutive lines of a document (blank ones are skipped, spaces in
and around lines don't count) are a window, which is hashed to 128 bits.
Windows that occur more than once in the corpus keep their first occurrence, by
doc_id, then place; all later ones cover their words, overlapping ones together,
and covered words are removed with the spaces behind them; lines of which all
words go, go too.

Lines may be long, and a passage of one or two of them would be in no window
that repeats. So runs of RUN words are windows, too: those that begin at a word
which, hashed with the next two, is the least of RUN neighbours, which depends on
nothing but the words around it; and the first and last RUN words of a text and
of each line of as many. Two runs of over 2 * RUN - 2 (that is, 50) equal words thus have a
window in common wherever lines begin and end, and windows within a run leave
no gap; of a run within lines up to RUN - 1 words stay at either end. Shorter
repeated runs may go, too, but none of fewer than RUN words unless it is three
lines. What goes always stays where it stood first.

Windows are found in Arrow batches, in one pass over the texts, and written;
hashes alone are counted first, and a Bloom filter of those that repeat drops
all other windows before anything else is shuffled. A window that a third of
the corpus has meets its one summary row in a join that Spark can split. A
document's own covered windows are the most that is gathered in one place.

Defined results: null and empty texts, and texts of fewer than RUN words and
three lines, stay as they are; null doc_ids come first; rows that repeat both
doc_id and text are one document and treated alike; an empty table gives an
empty result; other columns are left alone. Lines end with a line feed.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import SPACE, carried, cut, pieces, restored, text_of, word_count
from turnlake.llm.word_hashes import WordHashes, hashed_runs, least, mixed
from turnlake.operators import bloom

#: Lines in a window of lines, words in a window of words; 2 * RUN - 1 is at most 51.
LINES, RUN = 3, 26
#: Texts that are handled at a time.
TEXTS = 200

#: Factors of the second and third of three words, and a prime modulus, with which sums of 32-bit numbers stay below 2 ** 63.
MARKS = (1000003, 998244353, 4294967291)

def marks(hashes: np.ndarray) -> np.ndarray:
    """A number below 2 ** 32 for each three neighbouring words, so that a frequent word with a small one doesn't begin a window wherever it stands."""
    v = hashes >> np.uint64(32)
    return (v[:-2] + np.uint64(MARKS[0]) * v[1:-1] + np.uint64(MARKS[1]) * v[2:]) % np.uint64(MARKS[2])


def begins(hashes: np.ndarray, texts: np.ndarray, heads: np.ndarray, run: int = RUN) -> np.ndarray:
    """The words at which windows of ``run`` words begin, in the words of many texts; ``texts`` and ``heads`` are where texts and lines begin, and the end."""
    own = []
    for bounds in (texts, heads):
        long = np.diff(bounds) >= run
        own += [bounds[:-1][long], bounds[1:][long] - run]
    n = np.diff(texts)
    if n.max(initial=0) >= 2 * run - 1:
        at = least(marks(hashes), run)
        # Neighbours are of one text, and so are all words of their runs.
        k = np.arange(len(hashes)) - np.repeat(texts[:-1], n)
        own.append(at[np.flatnonzero(k + 2 * run - 1 <= np.repeat(n, n))])
    return np.unique(np.concatenate(own))


def scan(texts: list[str], known: dict) -> tuple[np.ndarray, ...]:
    """Number of the text, first word, word behind the last, and both halves of the hash of each window."""
    words, lengths, counts = array("Q"), array("q"), []
    for text in texts:
        before = len(lengths)
        for line in text.encode().split(b"\n"):
            # ``bytes`` splits at just the white space of the contracts.
            if said := line.split():
                words.extend(map(known.__getitem__, said))
                lengths.append(len(said))
        counts.append(len(lengths) - before)
    hashes = np.array(words, np.uint64)
    heads = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64))))
    n_lines = np.array(counts, np.int64)
    of_text = np.concatenate(([0], np.cumsum(n_lines)))
    bounds = heads[of_text]
    first = begins(hashes, bounds, heads)
    found = [hashed_runs(hashes, first, first + RUN)]
    # Words that begin a line count as others, so that windows of lines meet none but such.
    hashes[heads[:-1]] = mixed(~hashes[heads[:-1]])
    k = np.arange(len(heads) - 1) - np.repeat(of_text[:-1], n_lines)
    line = np.flatnonzero(k + LINES <= np.repeat(n_lines, n_lines))
    found.append(hashed_runs(hashes, heads[line], heads[line + LINES]))
    first, behind, h1, h2 = (np.concatenate(x) for x in zip(*found))
    of = np.searchsorted(bounds, first, "right") - 1
    return of, first - bounds[of], behind - bounds[of], h1, h2


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, text's hash, first word, word behind the last, and hash of every window."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("version"), text_of().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                of, first, behind, h1, h2 = scan(part.column("text").to_pylist(), known)
                columns = [part.column("doc_id").take(pa.array(of)), part.column("version").take(pa.array(of)), pa.array(first.astype(np.int32)), pa.array(behind.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "first", "behind", "h1", "h2"])

    return rows.mapInArrow(each, f"doc_id {kind}, version long, first int, behind int, h1 long, h2 long")


def covered(docs: DataFrame) -> DataFrame:
    """of_doc, of_version, and first word and word behind the last of each window to remove, in one array."""
    found = cut(windows(docs), "windows")
    here = F.struct("doc_id", "version", "first", "behind")
    # Half a hash tells nearly all windows that occur once; what it lets through is compared in full.
    again = cut(found.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "again")
    n = again.count()
    some = cut(bloom.possible(found, F.xxhash64("h1"), bloom.built(again.select(F.xxhash64("h1")), n), n), "some")
    repeated = some.groupBy("h1", "h2").agg(F.min(here).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Rows that repeat doc_id and text count twice but have the same place, which is kept.
    later = some.join(cut(repeated, "repeated").hint("merge"), ["h1", "h2"]).where(~here.eqNullSafe(F.col("kept")))
    spans = later.groupBy("doc_id", "version").agg(F.flatten(F.collect_set(F.array("first", "behind"))).alias("gone"))
    return spans.select(F.col("doc_id").alias("of_doc"), F.col("version").alias("of_version"), "gone")


def without(text: str, spans: Sequence[int]) -> tuple[str, int, str]:
    """A text without the words of the spans (first word and the one behind the last, in turn), their number, and what was removed; a line of which all words go, goes too."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([0], ((data != 32) & ((data < 9) | (data > 13))).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    gone = np.zeros(len(starts) + 1, np.int32)
    np.add.at(gone, np.asarray(spans[::2], np.int64), 1)
    np.add.at(gone, np.asarray(spans[1::2], np.int64), -1)
    gone = np.cumsum(gone) > 0
    edge = np.diff(np.concatenate(([0], gone[:-1].view(np.int8), [0])))
    out, at, pairs = [], 0, list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
    for a, b in pairs:
        end = int(starts[b]) if b < len(starts) else len(raw)
        between, begin = raw[ends[b - 1] : end], len(raw[: starts[a]].rstrip(b" \t\r\x0b\x0c"))
        whole_line = begin == 0 or raw[begin - 1 : begin] == b"\n"
        out.append(raw[at : begin if whole_line and (b"\n" in between or end == len(raw)) else int(starts[a])])
        if b"\n" in between:
            at = int(ends[b - 1]) + (between.rindex(b"\n") + 1 if whole_line else between.index(b"\n"))
        else:
            at = end
    return b"".join([*out, raw[at:]]).decode(), int(gone.sum()), ",".join(f"{a}-{b}" for a, b in pairs)


_LESS = pa.struct([("text", pa.string()), ("n_removed", pa.int64()), ("removed", pa.string())])


def _cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """What :func:`without` makes of each text that has spans, some at a time, so that few are copied at once."""
    done = []
    for at in range(0, len(texts), TEXTS):
        part = [without(t.as_py(), x.as_py()) if t.is_valid else (None, 0, "") for t, x in zip(texts[at : at + TEXTS], spans[at : at + TEXTS])]
        done.append(pa.StructArray.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*part), _LESS)], fields=list(_LESS)))
    return pa.concat_arrays(done) if done else pa.array([], _LESS)


def removed(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) without the words that ``gone`` (of_doc, of_version, spans) names, n_removed and removed (words from 0: first-behind, comma-joined)."""
    rows = docs.join(gone, docs.doc_id.eqNullSafe(gone.of_doc) & (F.xxhash64(text_of()) == gone.of_version), "left")
    rows = rows.withColumn("less", F.arrow_udf(_cut_out, "text string, n_removed long, removed string")(F.when(F.col("gone").isNotNull(), F.col("text")), F.col("gone")))
    text = F.coalesce(F.col("less.text"), F.col("text"))
    return rows.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], F.coalesce("less.n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("less.removed", F.lit("")).alias("removed")
    )


def dedup(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id and text without covered words, what :func:`carried` makes of ``carry``, n_removed and removed (words from 0: first-behind, comma-joined)."""
    docs = carried(docs, carry, "doc_id", "text")
    return removed(docs, covered(docs.select("doc_id", "text")))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with their columns, covered words cut out of text; n_chars, where there is one, follows."""
    rows, kinds = dedup(docs, docs.columns), dict(docs.dtypes)
    return rows.select(*[F.when(F.col("n_removed") > 0, F.length("text").cast(kinds[c])).otherwise(x).alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, restored(docs.columns, "doc_id", "text"))])


def report(docs: DataFrame) -> DataFrame:
    """For each document: doc_id, n_words, n_removed, removed, and words_sha256 of the words that stay, space-joined."""
    left = F.array_join(pieces(text_of(), f"[{SPACE}]+"), " ")
    return dedup(docs).select("doc_id", (word_count(text_of()) + F.col("n_removed")).alias("n_words"), "n_removed", "removed", F.sha2(left.cast("binary"), 256).alias("words_sha256"))
