import random

import numpy as np

from tests.llm.conftest import DOCS, rows_of
from turnlake.llm import near_dedup


def shingles(text, size):
    w = (text or "").encode().lower().split()
    k = min(size, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


def brute(rows, size):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        best[r] = min([j for j in (best.get(r), i) if j is not None], default=None)
    out = [(i, len(s), best[find(k)] if s else i) for k, (i, s) in enumerate(sets)]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=lambda t: tuple((x is not None, x) for x in t))


def mutated(rng, words, share):
    return [rng.choice("qrstuvw") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def corpus(seed=1):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(40):
        base = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 7)):
            rows.append((k := k + 1, " ".join(mutated(rng, base, rng.choice([0, 0.01, 0.03, 0.06])))))
    return rows


def test_matches_brute_force(docs):
    rows = corpus() + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "Éa b"), (906, "éa b"), (907, "w " * 9000), (908, "w w"), (None, "one"), (909, "a b c")]
    for size in (2, 5):
        assert rows_of(near_dedup.groups(docs(*rows), size)) == brute(rows, size)


def test_a_large_group_of_near_copies_becomes_one(docs):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(mutated(rng, base, 0.02))) for k in range(400)] + [(1000 + k, " ".join(mutated(rng, base, 0.3))) for k in range(30)]
    assert rows_of(near_dedup.groups(docs(*rows), 2)) == brute(rows, 2)


def test_links_that_only_the_second_search_finds(spark, docs, monkeypatch):
    """Without any link from the stars, the crossing join has to find all."""
    real, calls = near_dedup.linked, []

    def none_first(pairs, *rest):
        calls.append(1)
        return real(pairs, *rest) if len(calls) > 1 else real(pairs.where("false"), *rest)

    monkeypatch.setattr(near_dedup, "linked", none_first)
    real_groups = near_dedup.groups
    rows = [(1, "a b c d e f g h i j k l m n o p"), (2, "a b c d e f g h i j k l m n o p q"), (3, "z y x")]
    crossing = near_dedup.crossing
    monkeypatch.setattr(near_dedup, "crossing", lambda buckets, classes, roots, least: crossing(buckets, classes, roots, least).selectExpr("a + 0 a", "b + 0 b"))
    got = real_groups(docs(*rows), 2)
    # The stars' pairs count as compared, so nothing is left to compare here; the crossing pairs themselves hold the link.
    assert got.count() == 3 and len(calls) == 2


def test_crossing_finds_every_pair_of_different_components(spark, docs):
    rows = corpus(3)
    found = near_dedup.summaries(docs(*rows), 2).where("n > 0").dropDuplicates(["set_hash"]).withColumnRenamed("doc_id", "node")
    classes = near_dedup.cut(found, "test")
    buckets = near_dedup.keys(classes)
    none = spark.createDataFrame([], "node long, root long")
    pairs = {(r["a"], r["b"]) for r in near_dedup.crossing(buckets, classes, none, 80).collect()}
    texts, nodes = dict(rows), [r["node"] for r in classes.select("node").collect()]
    for a in nodes:
        for b in nodes:
            x, y = shingles(texts[a], 2), shingles(texts[b], 2)
            if a > b and 100 * len(x & y) >= 80 * len(x | y):
                assert (a, b) in pairs


def test_every_pair_within_the_distance_shares_a_key():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n = near_dedup.CHUNKS * near_dedup.SYMBOLS
    worst = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        b = a.copy()
        b[rng.choice(n, worst, replace=False)] += np.uint32(1)
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array([a.tobytes(), b.tobytes()])], ["node", "signature"])
        keys = [{}, {}]
        for out in near_dedup._keys([batch]):
            for k, node in zip(out.column("key").to_pylist(), out.column("node").to_pylist()):
                keys[node][k] = 1
        assert keys[0].keys() & keys[1].keys()


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300), (200, 201)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)} | {201: 200, 202: 200}


def test_empty_table_repeats_and_other_columns(spark, docs):
    assert near_dedup.groups(spark.createDataFrame([], DOCS)).count() == 0
    assert rows_of(near_dedup.groups(docs((1, "a b"), (1, "a b"), (1, "c d e"), (2, "a b")), 2)) == [(1, 1, 1, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False)]
    twice = docs((1, "a b c d e f"), (1, "a b c d e f"), (None, "q r s"), (None, "q r s"), (None, "q  r s"), (None, "other"), (3, ""), (4, None), (4, None))
    assert rows_of(near_dedup.dedup(twice), "doc_id", "text").count((1, "a b c d e f")) == 1
    assert [i for i, _ in rows_of(near_dedup.dedup(twice), "doc_id", "text")] == [None, None, 1, 3, 4]
    clash = docs((1, "a b c"), (2, "a b c")).withColumnsRenamed({"lang": "Doc_ID", "source": "node"})
    assert rows_of(near_dedup.dedup(clash).toDF("a", "b", "c", "d", "e"), "a", "c", "d") == [(1, "en", "s")]
    odd = spark.createDataFrame([(1, "a b c", "x", 1), (2, "a  b c", "y", 2)], "doc_id long, text string, node string, kept int")
    left = near_dedup.dedup(odd)
    assert left.columns == odd.columns and rows_of(left) == [(1, "a b c", "x", 1)]


def test_a_family_of_documents_below_the_threshold(docs):
    """Templates of similarity 0.7 share buckets but no component; near copies of some are found among them."""
    rng = random.Random(5)
    form = [f"form{k}" for k in range(330)]
    rows = [(k, " ".join(form + [f"own{k}x{j}" for j in range(70)])) for k in range(600)]
    rows += [(1000 + k, rows[k][1] + f" tail{k}") for k in rng.sample(range(600), 40)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs(*rows), 2).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
