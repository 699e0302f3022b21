"""Toxicity by weak supervision.

Many voters look at a text: fixed lists of insults, and patterns (words, and
families of words that begin alike) that the labelled rows of the training
folds suggest. A generative label model, in which the labels are one more
voter, estimates by expectation maximisation how often each voter fires for
either class and how far voters repeat each other, and gives each training text
a posterior. A linear classifier over thousands of word and family features is
then fitted to the posteriors, and scores every whole text.

Only the fit uses a sample: at most SAMPLE labelled rows, chosen by a hash of
their doc_id, never rows of the held-out fold (crc32 of the doc_id as text, mod
3, is 1). Labels, lang, source and doc_id are no inputs of a score. The model is
a table of a few thousand weights; scoring is one pass over the texts without a
shuffle.

Defined results: null and empty texts get the score of a text without any
feature; a null doc_id is held out from training and marked so as false; rows
that repeat a doc_id are scored each; a doc_id that is labelled twice counts as
toxic if any of its labels says so; without labelled rows the fixed lists score
alone; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import cut, pick, text_of

#: Labelled rows that a fit reads, at most; features and voters that it keeps, at most.
SAMPLE, FEATURES, VOTERS = 20_000, 4096, 60
#: Standard errors by which a feature's share of toxic texts has to differ from the whole sample's.
LIFT = 3.5
#: Score from which a text is rejected.
TOXIC = 0.7
#: Lengths of the word beginnings that make a family.
STEMS = (3, 4, 5, 6)
#: Training texts that a pattern must be in, and the share of toxic ones among them (less two standard errors), to become a voter.
SUPPORT, PRECISION = 5, 0.7
#: Entries that a task gathers before it hands them on.
HELD = 200_000

# The lists of the lexicon voters. A word of a list also has the list as a feature.
LEXICONS = {
    "contempt": "idiot idiots moron morons stupid dumb loser losers imbecile fool fools clown clowns",
    "disgust": "scum trash garbage filth vermin disgusting pathetic worthless repulsive vile",
    "hostile": "hate despise kill destroy threat",
}
#: Lists that are insults without any context, and what each adds to a score without a fit.
INSULTS, INSULT, CALM = ("contempt", "disgust"), 5.0, -4.0
_LISTS: dict[str, list[str]] = {}
for _name, _words in LEXICONS.items():
    for _word in _words.split():
        _LISTS.setdefault(_word, []).extend([f"#{_name}", *["#insult"] * (_name in INSULTS)])
_WORD = re.compile(r"[^\W\d_]{2,}")


def fold(doc_id: Column) -> Column:
    """True for the held-out rows."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def features_of(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in STEMS if len(word) >= k], *_LISTS.get(word, ())]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass(frozen=True)
class Model:
    """Weights of features; a score is the logistic function of bias and the weights of a text's features."""

    weights: dict[str, float]
    bias: float


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (feature, texts, toxic texts), summed as far as a task can hold them."""

    def out(held: dict) -> pa.RecordBatch:
        both = np.array(list(held.values()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["feature", "n", "toxic"])

    held: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            for f in {f for w in words_of(text.as_py()) for f in features_of(w)}:
                held[f][0] += 1
                held[f][1] += toxic
            if len(held) >= HELD:
                yield out(held)
                held.clear()
    if held:
        yield out(held)


def _present(known: Sequence[str]):
    """A function for mapInArrow: (text, toxic) to the numbers of the known features in the text, as 32-bit integers in bytes."""
    number = {f: k for k, f in enumerate(known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Known(number)
        for batch in batches:
            rows = [np.array(sorted({k for w in words_of(t.as_py()) for k in seen[w]}), np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.binary())], ["toxic", "features"])

    return run


class _Known(dict):
    """Numbers of the known features of a word; forgets all when it gets too large."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= HELD:
            self.clear()
        self[word] = out = tuple(self.number[f] for f in features_of(word) if f in self.number)
        return out


def _families(found: Sequence[tuple[str, int, int]]) -> list[str]:
    """Patterns that vote: precise ones, without those that a shorter one covers as precisely."""
    kept: list[str] = []
    for feature, n, toxic in sorted(found, key=lambda x: (-x[2], len(x[0]), x[0])):
        share = toxic / n
        if n < SUPPORT or share - 2 * np.sqrt(max(share * (1 - share), 1 / n) / n) < PRECISION:
            continue
        if not any(k.endswith("*") and feature.startswith(k[:-1]) for k in kept):
            kept.append(feature)
    return kept[:VOTERS]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of the toxic class for each row of ``votes`` (0 or 1 of each voter), and what was estimated.

    A latent class model: voters fire with a rate for each class. Voters that
    fire together within a class more than independence allows share their
    weight: each counts as one over the sum of its positive correlations. The
    labels, which may be wrong, are one more voter, the last; votes that agree
    well enough outweigh it.
    """
    votes = np.column_stack([votes, labels.astype(float)])
    n, k = votes.shape
    q = np.clip(labels.astype(float), 0.05, 0.95)
    rate, weight, correlation = np.zeros((2, k)), np.ones(k), np.eye(k)
    for _ in range(rounds):
        for y, p in enumerate((1 - q, q)):
            rate[y] = (p @ votes + (0.02, 0.2)[y]) / (p.sum() + 1)
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        prior = np.clip(q.mean(), 1e-3, 0.5)
        centred = votes - (1 - q)[:, None] * rate[0] - q[:, None] * rate[1]
        cov = centred.T @ centred / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation = np.clip(cov / sd[:, None] / sd[None, :], 0, 1)
        weight = 1 / np.maximum((correlation * (correlation > 0.1)).sum(1), 1)
        weight[-1] = 1
        odds = np.log(prior / (1 - prior)) + (votes * np.log(rate[1] / rate[0]) + (1 - votes) * np.log((1 - rate[1]) / (1 - rate[0]))) @ weight
        before, q = q, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(q - before).max() < 1e-4:
            break
    return q, {"rate": rate, "weight": weight, "correlation": correlation}


def linear(rows: np.ndarray, cols: np.ndarray, n: int, k: int, target: np.ndarray, penalty: float = 2e-5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on texts given as (row, feature) pairs, by full gradient steps."""
    w, b = np.zeros(k), float(np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], n), -30, 30)))
        e = (p - target) / n
        g = np.append(np.bincount(cols, e[rows], k) + penalty * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled documents outside the held-out fold."""
    lists = [f"#{name}" for name in LEXICONS]
    known = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~fold(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # The bound on the sample is also the bound on what is broadcast: two numbers for each of its rows.
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(few), "doc_id").select(text_of().alias("text"), "toxic")
    rows = cut(rows, "labelled")
    counted = rows.mapInArrow(_counts, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where("n >= 3")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not toxic or toxic == n:
        return Model(dict.fromkeys([f"#{name}" for name in INSULTS], INSULT), CALM)
    a, c = F.col("toxic"), F.col("n")
    # How far a feature's texts differ from all in their share of toxic ones, in standard errors.
    lift = F.abs(a - c * toxic / n) / F.sqrt(c * toxic / n * (1 - toxic / n) + 1)
    best = [tuple(r) for r in counted.where(lift >= LIFT).orderBy(lift.desc(), "feature").limit(FEATURES).collect()]
    names = [f for f, *_ in best]
    names += [f for f in [*lists, "#insult"] if f not in names]
    found = rows.mapInArrow(_present(names), "toxic int, features binary").collect()
    number = {f: k for k, f in enumerate(names)}
    cols = np.frombuffer(b"".join(r["features"] for r in found), np.int32)
    at = np.repeat(np.arange(len(found), dtype=np.int32), [len(r["features"]) // 4 for r in found])

    voters: list[set[int]] = [{number[f]} for f in _families([x for x in best if x[0][0] != "#"])]
    voters += [{number[f]} for f in lists]
    fires = np.zeros((len(voters), len(names)), bool)
    for k, own in enumerate(voters):
        fires[k, list(own)] = True
    votes = np.zeros((len(found), len(voters)))
    for k in range(len(voters)):
        votes[at[fires[k, cols]], k] = 1
    posterior, _ = label_model(votes, np.array([r["toxic"] for r in found]))
    w, b = linear(at, cols, len(found), len(names), posterior)
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-4}, b)


def _score(model: Model, text_at: int):
    names = list(model.weights)
    number, weight = {f: k for k, f in enumerate(names)}, np.array([*model.weights.values(), 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Known(number)
        for batch in batches:
            out = []
            for text in batch.column(text_at):
                present = {k for w in words_of(text.as_py() or "") for k in seen[w]}
                out.append(model.bias + float(weight[sorted(present)].sum()) if present else model.bias)
            score = 1 / (1 + np.exp(-np.clip(np.array(out), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all their columns, numbered c0, c1 and so on, and a score."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return plain.mapInArrow(_score(model, docs.columns.index("text")), f"{kinds}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each document: doc_id, held_out, score, predicted."""
    rows = scored(pick(docs, "doc_id", "text"), fit(docs, labels)).select(F.col("c0").alias("doc_id"), "score")
    return rows.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns."""
    return scored(docs, fit(docs, labels)).where(F.col("score") < TOXIC).drop("score").toDF(*docs.columns)
