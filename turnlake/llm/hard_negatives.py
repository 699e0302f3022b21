"""Hard negatives for anchors, by a vector-approximation file.

A row's score for an anchor is their inner product over integers. An anchor's
positives are its best rows of the same label; for each of them the best rows of
other labels are wanted whose score lies in a window relative to the positive's.

Every dimension is cut into CELLS cells at quantiles of all rows, so a vector's
approximation is one byte a dimension. A table holds the least and greatest
number of each cell; looked up for a block of rows and multiplied with a block
of anchors (by sign), it gives a lower and an upper bound of each score. Scores
are worked out from the vectors only for rows whose bounds reach above the
threshold that the anchor's best so far have set and overlap a window; so nothing
that could be in a result is passed over, whatever the cells are.

Anchors meet all rows in blocks: a block of anchors and a slice of rows is one
task, which keeps no more than the best of each anchor and window. There are at
most SLICES slices, so what the tasks give back is in proportion to the anchors.
Only the cells' limits come to the driver, a few thousand numbers.

Defined results: rows with a null id, label or vector, or a null component are
left out (the query leaves out others); of rows with the same id that with the
least label, then vector stays; shorter vectors count as padded with zeros; ties
in score go by the smaller id; anchors without positives, and positives without
a row in their window, have no rows; an empty table gives an empty result; extra
columns are left aside. Scores that might pass 63 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import cut, pick

#: Cells of a dimension: what a byte can tell.
CELLS = 256
#: Rows and anchors in a block, slices of rows, and blocks of anchors in a task.
BLOCK, SLICES, BLOCKS_A_TASK = 256, 16, 4
#: Positives of an anchor, negatives of a positive, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, FROM, TO = 5, 10, 30, 90
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Cells:
    """Upper limits of the cells of each dimension, the numbers that the cells hold from and to, and the largest magnitude."""

    ends: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    most: np.ndarray

    @property
    def width(self) -> int:
        return len(self.ends)

    @property
    def kind(self) -> type:
        """The smallest type that holds the components."""
        return next(t for t in (np.int16, np.int32, np.int64) if self.most.max(initial=0) <= np.iinfo(t).max)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, vectors[:, d]) for d, e in enumerate(self.ends)], 1).astype(np.uint8) if self.width else np.zeros((len(vectors), 0), np.uint8)

    def bounds(self, codes: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of rows with anchors, whose positive and negative components are apart."""
        d = np.arange(self.width)
        low, high = self.low[d, codes], self.high[d, codes]
        # Sums beyond 53 bits are not exact, so the bounds give way a little.
        slack = (up - down) @ self.most.astype(np.float64)
        slack = np.where(slack < 2.0**53, 0.0, slack * 1e-12)
        return low @ up.T + high @ down.T - slack, high @ up.T + low @ down.T + slack


def fitted(rows: DataFrame) -> Cells:
    """Cells at quantiles of all rows' components, and their ends at the least and greatest."""
    each = rows.select(F.posexplode("vector").alias("d", "x")).groupBy("d")
    marks = [k / CELLS for k in range(1, CELLS)]
    found = each.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", marks, 1000).alias("marks")).orderBy("d").collect()
    ends, low, high = [], np.zeros((len(found), CELLS)), np.zeros((len(found), CELLS))
    for d, r in enumerate(found):
        # Shorter vectors have zeros here, so cells must hold those, too.
        least, most = min(r["least"], 0), max(r["most"], 0)
        own = np.unique(np.array([*r["marks"], most], np.int64))
        ends.append(own)
        high[d, : len(own)], low[d, : len(own)] = own, np.concatenate(([least], own[:-1] + 1))
    most = np.array([max(abs(r["least"]), abs(r["most"])) for r in found], np.int64)
    if sum(int(m) ** 2 for m in most) >= 1 << 63:
        raise ValueError("scores of these vectors might pass 63 bits")
    return Cells(ends, low, high, most)


_BLOCK = "ids binary, labels binary, vectors binary, codes binary, positives binary, scores binary"


def packed(rows: DataFrame, cells: Cells) -> DataFrame:
    """Blocks of rows (id, label, vector, and positives with their scores where there are any) as arrays of numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = _matrix(part.column("vector"), cells.width, 0)
                out = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label")] + [vectors.astype(cells.kind), cells.codes(vectors)]
                out += [_matrix(part.column(c), POSITIVES, _NONE) for c in ("positives", "scores")]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], ["ids", "labels", "vectors", "codes", "positives", "scores"])

    none = F.array().cast("array<long>")
    full = rows.select("id", "label", "vector", *[F.col(c) if c in rows.columns else none.alias(c) for c in ("positives", "scores")])
    return full.mapInArrow(each, _BLOCK)


def _matrix(lists: pa.Array, width: int, blank: int) -> np.ndarray:
    """Lists of numbers as rows, padded."""
    n = np.diff(lists.offsets.to_numpy())
    out = np.full((len(n), width), blank, np.int64)
    of = np.repeat(np.arange(len(n)), n)
    out[of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Best:
    """The best scores of each slot, ties by the smaller id."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.slots = keep, slots
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: What a row must reach to get in.
        self.least = np.full(slots, _NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        slot, score, id_ = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.id, id_))
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        here = rank < self.keep
        self.slot, self.score, self.id, rank = slot[here], score[here], id_[here], rank[here]
        full = rank == self.keep - 1
        self.least[self.slot[full]] = self.score[full]


@dataclass
class Block:
    """A block of rows or anchors, read from bytes."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    positives: np.ndarray
    scores: np.ndarray

    @classmethod
    def read(cls, fields: list[bytes], cells: Cells) -> Block:
        types, widths = (np.int64, np.int64, cells.kind, np.uint8, np.int64, np.int64), (None, None, cells.width, cells.width, POSITIVES, POSITIVES)
        n = len(fields[0]) // 8
        ids, labels, vectors, codes, positives, scores = (np.frombuffer(f, t).reshape((n,) if w is None else (n, w)) for f, t, w in zip(fields, types, widths))
        return cls(ids, labels, vectors.astype(np.int64), codes, positives, scores)


class Search:
    """One block of anchors on its way through rows."""

    def __init__(self, anchors: Block, cells: Cells):
        self.anchors, self.cells = anchors, cells
        self.up, self.down = np.maximum(anchors.vectors, 0).astype(np.float64), np.minimum(anchors.vectors, 0).astype(np.float64)

    def exact(self, rows: Block, r: np.ndarray, a: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", rows.vectors[r], self.anchors.vectors[a])


class Positives(Search):
    """The best rows of each anchor's own label."""

    SCHEMA = "anchor_id long, positive_id long, positive_score long"

    def __init__(self, anchors: Block, cells: Cells):
        super().__init__(anchors, cells)
        self.best = Best(len(anchors.ids), POSITIVES)

    def take(self, rows: Block) -> None:
        _, high = self.cells.bounds(rows.codes, self.up, self.down)
        may = (rows.labels[:, None] == self.anchors.labels) & (rows.ids[:, None] != self.anchors.ids) & (high >= self.best.least)
        r, a = np.nonzero(may)
        self.best.add(a, self.exact(rows, r, a), rows.ids[r])

    def found(self) -> list[np.ndarray]:
        return [self.anchors.ids[self.best.slot], self.best.id, self.best.score]


class Negatives(Search):
    """The best rows of other labels in the window of each of an anchor's positives."""

    SCHEMA = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"

    def __init__(self, anchors: Block, cells: Cells):
        super().__init__(anchors, cells)
        self.best = Best(anchors.scores.size, NEGATIVES)
        some, top = anchors.scores != _NONE, np.iinfo(np.int64).max
        score = [[int(x) if x != _NONE else 0 for x in row] for row in anchors.scores.tolist()]
        # Least and greatest whole scores in the window; none where there is no positive.
        self.least = np.where(some, np.array([[-(-FROM * x // 100) for x in row] for row in score], np.int64).reshape(some.shape), top)
        self.most = np.where(some, np.array([[TO * x // 100 for x in row] for row in score], np.int64).reshape(some.shape), _NONE)

    def take(self, rows: Block) -> None:
        low, high = self.cells.bounds(rows.codes, self.up, self.down)
        need = np.maximum(self.least, self.best.least.reshape(self.least.shape))
        may = np.zeros(low.shape, bool)
        for j in range(POSITIVES):
            may |= (high >= need[:, j]) & (low <= self.most[:, j])
        r, a = np.nonzero(may & (rows.labels[:, None] != self.anchors.labels))
        score, ids = self.exact(rows, r, a), rows.ids[r]
        for j in range(POSITIVES):
            in_ = (score >= need[a, j]) & (score <= self.most[a, j])
            if in_.any():
                self.best.add(a[in_] * POSITIVES + j, score[in_], ids[in_])

    def found(self) -> list[np.ndarray]:
        a, j = np.divmod(self.best.slot, POSITIVES)
        return [self.anchors.ids[a], self.anchors.positives[a, j], self.best.id, self.anchors.scores[a, j], self.best.score]


def searched(anchors: DataFrame, rows: DataFrame, cells: Cells, kind: Callable[[Block, Cells], Search]) -> DataFrame:
    """What ``kind`` finds in each slice of rows for each block of anchors."""
    names = [f.split()[0] for f in _BLOCK.split(", ")]
    pairs = anchors.select(*[F.col(c).alias(f"a_{c}") for c in names]).hint("shuffle_replicate_nl").crossJoin(rows.select(*[F.col(c).alias(f"r_{c}") for c in names]))
    columns = [f.split()[0] for f in kind.SCHEMA.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, of = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in search.found()], columns)

        for batch in batches:
            data = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                ids = data["a_ids"][k].as_py()
                if ids != of:
                    if search is not None:
                        yield told()
                    search, of = kind(Block.read([data[f"a_{c}"][k].as_py() for c in names], cells), cells), ids
                search.take(Block.read([data[f"r_{c}"][k].as_py() for c in names], cells))
        if search is not None:
            yield told()

    return pairs.mapInArrow(each, kind.SCHEMA)


def mined(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from id, label (whole numbers) and vector (an array of longs); ``is_anchor`` is a condition on id."""
    kept = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    one = kept.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    vectors = cut(one.select(F.col("id").cast("long").alias("id"), F.col("row.label").cast("long").alias("label"), "row.vector"), "vectors")
    cells = fitted(vectors)
    anchors = cut(vectors.where(is_anchor), "anchors")
    n = anchors.count()
    parts = max(1, -(-n // (BLOCK * BLOCKS_A_TASK)))
    blocks = cut(packed(vectors, cells), "blocks").coalesce(SLICES)
    best = searched(packed(anchors.repartition(parts), cells), blocks, cells, Positives)
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = best.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= POSITIVES)
    listed = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("positive_id").alias("positives"), F.collect_list("positive_score").alias("scores"))
    ready = cut(anchors.join(listed, "id"), "ready")
    found = searched(packed(ready.repartition(parts), cells), blocks, cells, Negatives)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Factor of components, which are floored then; labels are below LABELS; each ANCHOR-th id is an anchor, each MOVED-th has its label moved on.
SCALE, LABELS, ANCHOR, MOVED = 256, 10, 100, 7


def report(embeddings: DataFrame) -> DataFrame:
    """The hard negatives of ``embeddings`` (vec_id, embedding, label), as whole numbers; rows with a component that is null or not finite take no part."""
    rows = pick(embeddings, "vec_id", "embedding", "label")
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vector = F.transform(x, lambda v: F.floor(v * SCALE).cast("long"))
    fit = rows.where(F.col("embedding").isNotNull()).where(~bad)
    return mined(fit.select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector")), F.col("id") % ANCHOR == 0)
