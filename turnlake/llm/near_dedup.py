"""MinHash near-dedup by a multi-index Hamming join.

Each text is the set of its word shingles. Equal sets are one class. A class
gets a signature of 50 b-bit symbols (b is 32), cut into 10 chunks of 5. By the
pigeonhole principle two signatures that differ in at most 19 symbols have a
chunk that differs in at most one, so each chunk is entered five times, once
with each of its symbols left out: these 50 keys enumerate the allowed chunk
errors, and classes that share a key are candidates. Every pair within 19
symbols is one; of pairs with similarity 0.8 about one in a million isn't.

Candidates are linked only after their full sets of shingles are compared. The
pairs of a bucket are never listed. First each class of a bucket is compared
with one class only, the one that meets most others, and what is linked becomes
one component.
Then only classes of different components that share a bucket are joined,
those outside the bucket's largest component with all others, and only if
their sizes allow the similarity and so do their parity sketches: bit strings
in which every shingle flips one bit. Sketches of sets differ in at most as
many bits as the sets do in shingles, so this drops no link.

Components are found by star contractions, each step written to the shared
folder. Nothing that grows with the table is sent to the driver.

Defined results: null and empty texts, and texts without words, have an empty
set and are linked with nothing; texts with fewer words than a shingle have
one, all their words; of a component the smallest doc_id stays (nulls last);
rows that repeat a doc_id are classes of their own where their sets differ;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import carried, cut, pick, restored, text_of

#: Words in a shingle, and similarity in hundredths, unless a caller says otherwise.
SHINGLE, LEAST = 5, 80
#: Chunks of a signature, symbols in a chunk, and errors allowed in one of them.
CHUNKS, SYMBOLS, ERRORS = 10, 5, 1
#: Words of 64 bits in a parity sketch.
SKETCH = 32
#: Shingles that are hashed at a time, and words whose hashes are remembered.
BLOCK, REMEMBERED = 8192, 200_000

_SCHEMA = "version long, n int, set_hash binary, signature binary, sketch array<bigint>"


class _Hashes(dict):
    """64-bit hashes of words; forgets all when it gets too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    n = CHUNKS * SYMBOLS
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; ``bytes`` splits at just the contract's white space."""
    return text.lower().split()


def shingle_hashes(words: Sequence[bytes], size: int, known: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    size = min(size, len(h))
    x = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(x)


def _summaries(size: int):
    """A function for mapInArrow: (doc_id, version, text) to doc_id and _SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (a, b) = _Hashes(), _factors()
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            for text in batch.column("text"):
                x = shingle_hashes(words_of(text.as_py()), size, known)
                signature, bits = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), np.zeros(SKETCH * 64, np.int64)
                for k in range(0, len(x), BLOCK):
                    signature = np.minimum(signature, (x[k : k + BLOCK, None] * a + b).min(0))
                np.add.at(bits, (x % np.uint64(SKETCH * 64)).astype(np.int64), 1)
                out["n"].append(len(x))
                out["set_hash"].append(xxhash.xxh3_128_digest(x.tobytes()))
                out["signature"].append((signature >> np.uint64(32)).astype(np.uint32).tobytes())
                out["sketch"].append(np.packbits((bits & 1).astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(out["n"], pa.int32()), pa.array(out["set_hash"], pa.binary()), pa.array(out["signature"], pa.binary()), pa.array(out["sketch"], pa.list_(pa.int64()))],
                ["doc_id", "version", "n", "set_hash", "signature", "sketch"],
            )

    return run


def summaries(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, hash of the text, number of shingles, hash of the set, signature and parity sketch of each text."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64(text_of()).alias("version"), text_of().cast("binary").alias("text")).mapInArrow(_summaries(size), f"doc_id {kind}, {_SCHEMA}")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, CHUNKS, SYMBOLS).astype(np.uint64)
        node = np.asarray(batch.column("node"))
        for chunk in range(CHUNKS):
            for left_out in range(SYMBOLS):
                x = np.full(len(s), chunk * SYMBOLS + left_out + 1, np.uint64)
                for k in range(SYMBOLS):
                    if k != left_out:
                        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + s[:, chunk, k])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(node, pa.int64())], ["key", "node"])


def keys(classes: DataFrame) -> DataFrame:
    """(key, node): the chunks of each signature with every allowed error."""
    return classes.select("node", "signature").mapInArrow(_keys, "key long, node long")


def _compare(size: int, least: int):
    """A function for mapInArrow: keeps the pairs whose full sets of shingles are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple] = {}

        def shingles(side: str, node: int, text: bytes) -> set:
            if last.get(side, (None,))[0] != node:
                w = words_of(text)
                k = min(size, len(w))
                last[side] = (node, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
            return last[side][1]

        for batch in batches:
            good = []
            for k in range(batch.num_rows):
                a = shingles("a", batch.column("a")[k].as_py(), batch.column("a_text")[k].as_py())
                b = shingles("b", batch.column("b")[k].as_py(), batch.column("b_text")[k].as_py())
                both = len(a & b)
                if both and 100 * both >= least * (len(a) + len(b) - both):
                    good.append(k)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return run


def linked(pairs: DataFrame, texts: DataFrame, size: int, least: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose texts (node, text) are similar enough."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text").mapInArrow(_compare(size, least), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) is connected with; roots are left out.

    Large and small stars alternate until every node points at its root.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Both minima are written, so that the joins deal their sides out anew and Spark can split a node with many neighbours.
        low = cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = cut(large, "large")
        least = cut(large.groupBy("a").agg(F.min("b").alias("low")), "least")
        down = large.join(least, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        edges = cut(down.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(38, 0)))")).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def hubs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class and the class of its bucket that meets most others in all its buckets.

    That one is the nearest thing to a group's common original; a class at the
    edge of a group would be linked with few of the others.
    """
    met = buckets.groupBy("node").agg(F.sum("size").alias("met"))
    hub = buckets.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("hub"))
    return buckets.join(cut(hub, "hubs"), "key").where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def crossing(buckets: DataFrame, classes: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and may be similar enough."""
    of = buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = of.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("kinds"))
    facts = classes.select("node", "n", *[F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(SKETCH)])
    rows = cut(of.join(mixed.where("kinds > 1").drop("kinds"), "key").join(facts, "node"), "crossing")
    left = rows.where("root <> most")
    other = rows.select("key", *[F.col(c).alias(f"o_{c}") for c in ("node", "root", "n", *[f"s{k}" for k in range(SKETCH)])])
    differ = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"o_s{k}"))) for k in range(SKETCH)), F.lit(0))
    # Of sets with similarity t the difference is at most (1 - t) / (1 + t) of the sum of their sizes.
    fits = (
        (left.key == other.key) & (F.col("root") != F.col("o_root")) & ((F.col("o_root") == F.col("most")) | (F.col("node") < F.col("o_node")))
        & (100 * F.least("n", "o_n") >= least * F.greatest("n", "o_n")) & (differ * (100 + least) <= (100 - least) * (F.col("n") + F.col("o_n")))
    )
    return left.join(other, fits).select(F.greatest("node", "o_node").alias("a"), F.least("node", "o_node").alias("b")).distinct()


def _told(doc_id: Column, version: Column) -> list[Column]:
    """Plain keys of a text: rows that were joined by them lie together, and those that repeat one need no further shuffle to be told."""
    return [F.xxhash64(doc_id.isNull(), doc_id).alias("of_id"), version.alias("of_text")]


def members(docs: DataFrame, size: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The summaries of ``docs`` (doc_id, text), the component of each set of shingles, and the texts that stand for components.

    The second table has set_hash and component_id, the third doc_id and
    version of each component's text that stays.
    """
    found = cut(summaries(docs, size), "summaries")
    # A class is told by its smallest doc_id, nulls last, and the text that goes with it.
    of_class = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("of")
    one = found.where("n > 0").groupBy("set_hash").agg(of_class, *[F.first(c).alias(c) for c in ("n", "signature", "sketch")])
    classes = cut(one.select("set_hash", "of", "n", "signature", "sketch", F.monotonically_increasing_id().alias("node")), "classes")

    entered = keys(classes)
    # Summaries are written before they are joined, here and below: both sides of a join are then dealt out anew, and Spark can split a large bucket among tasks.
    shared = cut(entered.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    buckets = cut(entered.join(shared, "key"), "buckets")
    stars = cut(hubs(buckets), "stars")
    # Texts move once, and of those only what shares a bucket is kept for the comparisons.
    met = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", *_told(F.col("of.doc_id"), F.col("of.version")))
    own = docs.select(text_of().cast("binary").alias("text"), *_told(F.col("doc_id"), F.xxhash64(text_of())))
    texts = cut(own.join(met, ["of_id", "of_text"]).dropDuplicates(["of_id", "of_text"]).select("node", "text"), "texts")
    first = cut(linked(stars, texts, size, least), "links")
    roots = components(first)
    more = linked(crossing(buckets.select("key", "node"), classes, roots, least).join(stars, ["a", "b"], "left_anti"), texts, size, least)
    roots = components(first.unionByName(more))

    of = classes.join(roots, "node", "left").select("set_hash", "of", F.coalesce("root", "node").alias("root"))
    stands = cut(of.groupBy("root").agg(F.min("of").alias("of")), "ids")
    component = cut(of.select("set_hash", "root").join(stands, "root").select("set_hash", F.col("of.doc_id").alias("component_id")), "members")
    return found, component, stands.select("of.doc_id", "of.version")


def groups(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for each row of ``docs``."""
    found, component, _ = members(pick(docs, "doc_id", "text"), size, least)
    rows = found.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_hash")).alias("set_hash")).join(component, "set_hash", "left")
    of = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), of.alias("component_id"), F.col("doc_id").eqNullSafe(of).alias("kept"))


def dedup(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """One row of ``docs`` for each component, and one for each doc_id and text without words, with their columns.

    Of rows that repeat doc_id and text any one stays.
    """
    rows = carried(docs, docs.columns, "doc_id", "text")
    found, _, stands = members(rows.select("doc_id", "text"), size, least)
    stay = stands.unionByName(found.where("n = 0").select("doc_id", "version"))
    keyed = rows.select("*", *_told(F.col("doc_id"), F.xxhash64(text_of())))
    return keyed.join(stay.select(*_told(F.col("doc_id"), F.col("version"))).distinct(), ["of_id", "of_text"], "left_semi").dropDuplicates(["of_id", "of_text"]).select(*restored(docs.columns, "doc_id", "text"))
