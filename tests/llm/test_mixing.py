import random

from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, rows_of
from turnlake.llm import mixing

DOCS_NAMES = [c.split()[0] for c in DOCS.split(", ")]


def brute_targets(sizes):
    """Sizes by source to targets, by dealing out the excess until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    while len(target) < len(sizes):
        free = [s for s in order if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not above:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in above}
    return target


def brute_seats(votes, most, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        open_ = [p for p in votes if got[p] < most[p]]
        if not open_:
            break
        winner = min(open_, key=lambda p: (-votes[p] / (2 * got[p] + 1), p))
        got[winner] += 1
    return got


def test_seats_match_the_highest_quotients(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for group in range(60):
        n = rng.randrange(1, 9)
        votes = {p: float(rng.choice([0, 1, 7, 10, 99, rng.randrange(1, 5000)])) for p in range(n)}
        most = {p: rng.choice([0, 2, 10**6, 10**6]) for p in range(n)}
        seats = rng.choice([0, 1, 2, 7, 50, 333])
        if sum(votes.values()) == 0:
            seats = 0
        rows += [(group, p, votes[p], most[p], seats) for p in votes]
        expected |= {(group, p): s for p, s in brute_seats(votes, most, seats).items()}
    df = spark.createDataFrame(rows, "g int, p int, votes double, most long, seats long")
    got = {(r["g"], r["p"]): r["quota"] for r in mixing.apportion(df, ["g"], "p", "votes", "seats", "most").collect()}
    assert got == expected


def test_targets_match_resharing(spark):
    rng = random.Random(7)
    for n in (1, 2, 3, 7, 20):
        sizes = {(None if k == 3 else f"s{k}é"): rng.choice([1, 5, 100, 9000, 100000]) for k in range(n)}
        got = {r["name"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        expected = brute_targets(sizes)
        assert got.keys() == expected.keys() and all(abs(got[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in got)


def corpus(n=1500):
    rng = random.Random(9)
    return [(k, " ".join("w" * rng.randrange(1, 90)) if k % 50 else "long " * 2500, rng.choice(["hot"] * 9 + ["a", "b", "tiny" if k % 7 == 0 else "c", None, "ü"])) for k in range(n)]


def test_shares_meet_targets_and_limits(docs):
    rows = corpus()
    got = mixing.mix(docs(*rows), shard_words=20000).collect()
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = brute_targets(sizes)
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * target[s]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(200, 0.02 * target[s]), s


def test_reruns_and_other_partitions_agree(docs):
    rows = corpus(400)
    a = rows_of(mixing.mix(docs(*rows)))
    assert a == rows_of(mixing.mix(docs(*rows))) == rows_of(mixing.mix(docs(*rows[::-1]).repartition(7)))
    assert a != rows_of(mixing.mix(docs(*rows), seed=99))


def test_nulls_repeats_empty_tables_and_other_columns(spark, docs):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert rows_of(mixing.mix(docs((1, None, "a"), (2, "", None)))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    got = mixing.mix(docs((1, "a b " * 50, "s"), (1, "a b " * 50, "s"), (None, "c " * 100, "s"))).collect()
    assert [r["taken"] for r in got] == [100] * 3
    many = mixing.mix(docs(*[(None, f"w{k} " * 40, "s") for k in range(50)], *[(7, "same " * 30, "s")] * 50), shard_words=500).collect()
    assert len(many) == 100 and all(r["taken"] <= 3 * r["size"] for r in many) and abs(sum(r["taken"] for r in many) - 3500) < 200
    odd = docs((1, "x y " * 64, "s")).withColumn("rank", F.lit("r")).withColumn("size", F.lit(1)).drop("size")
    assert mixing.mix(odd, odd.columns).first()["rank"] == "r"


def test_columns_named_as_the_result_give_way(docs):
    odd = docs((1, "x y " * 64, "s"), (2, None, "s")).withColumns({"taken": F.lit("t"), "Size": F.lit(5), "source_size": F.lit(6), "target": F.lit(7)})
    got = mixing.chosen(odd)
    assert got.columns == [*DOCS_NAMES, *mixing.MADE] and rows_of(got, "doc_id", "size", "taken") == [(1, 128, 128)]


def test_bundles_share_their_source_evenly(docs):
    rows = [(k, "w " * 200, "ab"[k % 2]) for k in range(400)]
    plain, bundled = (sorted(mixing.mix(docs(*rows), shard_words=2000, bundle=b).collect()) for b in (1000, 3))
    total = lambda got, s: sum(r["taken"] for r in got if r["doc_id"] % 2 == s)
    for s in (0, 1):
        assert abs(total(plain, s) - total(bundled, s)) <= 2 * mixing.BLOCK_WORDS


def test_block_numbers_are_permuted(spark):
    assert all(all(p % d for d in range(2, 46342)) for p in mixing.PRIMES)
    for n in (1, 2, 7, 128, 1000, 4093):
        df = spark.range(n).select(mixing.turned(F.col("id"), F.lit(n), mixing._seeded(3, F.lit("x"))).alias("t"))
        assert sorted(r["t"] for r in df.collect()) == list(range(n))
