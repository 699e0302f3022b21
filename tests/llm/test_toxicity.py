import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, rows_of
from turnlake.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=5):
    """Texts of four made-up vocabularies; toxic ones hold some words of a family."""
    rng = random.Random(seed)
    stems = [("idiot", "scum"), ("zorvex", "zorvun"), ("quempi", "quempa")]
    plain = [[f"{a}{b}" for a in p for b in ("in", "or", "est", "al", "um")] for p in (("ba", "de", "ki"), ("lo", "mu", "na"), ("pe", "ri", "so"))]
    docs, labels = [], []
    for i in range(n):
        k, toxic = i % 3, rng.random() < 0.15
        words = [rng.choice(plain[k]) for _ in range(rng.randrange(20, 60))]
        if toxic:
            words[3:3] = [rng.choice(stems[k]) + ("" if k == 0 else rng.choice(["a", "en", "ix"])) for _ in range(rng.randrange(2, 5))]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_rows_are_told_apart(spark, docs):
    rows, labels = corpus(900)
    rows += [(5000, None), (5001, ""), (None, "zorvexa quempix"), (5002, "kior " * 30000)]
    got = {r["doc_id"]: r for r in toxicity.report(docs(*rows), spark.createDataFrame(labels, LABELS)).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in truth if got[i]["held_out"]} == set(held) and not got[None]["held_out"]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert all(got[i]["predicted"] == 1 for i in held if truth[i] and i % 3 == 0)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert got[5000]["score"] == got[5001]["score"] < 0.5 and got[5002]["predicted"] == 0


def test_held_out_labels_are_never_read(spark, docs):
    rows, labels = corpus(300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (rows_of(toxicity.report(docs(*rows), spark.createDataFrame(x, LABELS)), "doc_id", "score") for x in (labels, turned))
    assert a == b


def test_label_model_finds_rates_and_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    fire = lambda p, q: np.where(y, rng.random(4000) < p, rng.random(4000) < q).astype(float)
    one, two, three = fire(0.7, 0.02), fire(0.6, 0.05), fire(0.8, 0.01)
    noisy = np.where(rng.random(4000) < 0.1, ~y, y)
    q, found = toxicity.label_model(np.column_stack([one, two, three, three]), noisy)
    assert np.mean((q > 0.5) == y) > np.mean(noisy == y) + 0.04
    assert np.allclose(found["rate"][1][:3], (0.7, 0.6, 0.8), atol=0.08)
    assert found["weight"][2] < 0.7 < found["weight"][0]


def test_without_labels_and_with_empty_tables(spark, docs):
    none = spark.createDataFrame([], LABELS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.report(docs((1, "you idiot moron"), (2, "a calm text")), none).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.report(spark.createDataFrame([], DOCS), none).count() == 0


def test_the_stage_keeps_columns_and_clean_rows(spark, docs):
    rows, labels = corpus(600)
    odd = docs(*rows).withColumn("score", F.lit(9)).withColumn("c0", F.array(F.lit("x")))
    left = toxicity.clean(odd, spark.createDataFrame(labels, LABELS))
    assert left.columns == odd.columns and left.dtypes == odd.dtypes
    stay = {r["doc_id"] for r in left.collect()}
    assert len([i for i, _, t in labels if not t and i not in stay]) <= 2
    assert len([i for i, _, t in labels if t and i in stay]) <= 2


def test_repeated_labels_and_a_bounded_sample(spark, docs):
    rows, labels = corpus(300)
    twice = labels + [(i, 1, 0) for i, _, _ in labels[:50]]
    a, b = (toxicity.fit(docs(*rows), spark.createDataFrame(x, LABELS)) for x in (labels, twice))
    assert a == b
    assert toxicity.fit(docs(*rows), spark.createDataFrame(labels, LABELS), sample=60) != a
