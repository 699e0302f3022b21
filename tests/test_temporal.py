"""Interval and as-of joins, exact medians and mergeable sketches, against plain code."""

import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnlake.operators import asof, intervals, ranks, sketches, snapshots
from turnlake.plans import rollups


def spans(rng, n, keys, reach):
    return [(rng.choice(keys), k, s, s + int(rng.choice([0, 1, 10, 1000, 100_000]) * rng.random())) for k in range(n) for s in [rng.randrange(-reach, reach)]]


SPAN = "k string, id long, start long, end long"


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_are_those_of_a_nested_loop(spark, seed):
    rng = random.Random(seed)
    a, b = spans(rng, 250, "xxy", 200_000), spans(rng, 250, "xxyz", 200_000)
    odd = [(None, 900, 0, 10), ("x", 901, None, 5), ("x", 902, 5, None), ("x", 903, 10, 5), ("x", 904, -10**12, 10**12), ("x", 905, 7, 7), ("x", 905, 7, 7)]
    a, b = a + odd, b + odd
    got = Counter((r["a_id"], r["b_id"]) for r in intervals.overlaps(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ["k"]).collect())
    sound = lambda r: None not in r and r[2] <= r[3]
    want = Counter((x[1], y[1]) for x in a for y in b if sound(x) and sound(y) and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want and len(want) > 300


def test_a_hot_key_is_dealt_out_and_makes_two_rows_a_level(spark):
    rows = spark.range(30_000).select(F.lit("hot").alias("k"), F.col("id"), (F.col("id") * 5000).alias("start"), (F.col("id") * 5000 + F.col("id") % 3000).alias("end"))
    levels = rows.select(intervals._level(F.col("start"), F.col("end")).alias("level")).distinct()
    placed = intervals._placed(rows, ["k"], levels, "a")
    assert placed.count() <= 2 * 30_000 * levels.count() and placed.groupBy("level", "bin").count().agg(F.max("count")).first()[0] < 10
    assert intervals.overlaps(rows, rows, ["k"]).where("a_id <> b_id").count() == 0


def test_concurrency_by_step(spark):
    rng = random.Random(3)
    rows = spans(rng, 300, ["x", "x", "y", None], 300_000_000)
    got = {(r["k"], r["step"]): r["n"] for r in intervals.concurrency(spark.createDataFrame([*rows, ("x", 999, 5, None)], SPAN), ["k"], 1000).collect()}
    steps = {(k, x) for k, _, s, e in rows for x in (s // 1000, e // 1000 + 1)}
    assert got == {(k, x): sum(kk == k and s // 1000 <= x <= e // 1000 for kk, _, s, e in rows) for k, x in steps}
    assert intervals.concurrency(spark.createDataFrame([], SPAN), ["k"], 1000).count() == 0


def test_as_of_takes_the_last_value_over_spans(spark):
    rng = random.Random(4)
    left = [(rng.choice(["a", "a", "b", "c", None]), rng.randrange(0, 5000) if rng.random() < 0.95 else None, k) for k in range(600)]
    right = [(rng.choice(["a", "b", None]), rng.randrange(0, 5000) if rng.random() < 0.95 else None, v) for v in range(80)] + [("a", 100, 500), ("a", 100, 501)]
    stamp = lambda rows, name: spark.createDataFrame(rows, f"k string, s long, {name} long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    for span in (1, 60, 10_000):
        got = {r["id"]: r["v"] for r in asof.joined(stamp(left, "id"), stamp(right, "v"), ["k"], "at", span).collect()}
        want = {i: max(((s, v) for kk, s, v in right if kk == k and s is not None and s <= t), default=(0, None))[1] if k is not None and t is not None else None for k, t, i in left}
        assert got == want
    assert asof.joined(stamp(left[:3], "id"), stamp(right, "v").limit(0), ["k"], "at").select("v").distinct().collect() == [(None,)]


def test_medians_equal_the_built_in_one(spark):
    rng = random.Random(5)
    draw = [lambda: rng.gauss(0, 1), lambda: float(rng.randrange(-3, 4)), lambda: rng.random() * 10**9, lambda: -rng.random(), lambda: 2.5]
    rows = [(k, rng.choice(draw)() if rng.random() < 0.9 else None) for k in ("a", "b", None, "c") for _ in range({"a": 1001, "b": 500, "c": 1}.get(k, 80))] + [("none", None)]
    got = {r["k"]: r["median"] for r in ranks.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    values = defaultdict(list)
    for k, v in rows:
        if v is not None:
            values[k].append(v)
    assert got == pytest.approx({k: statistics.median(v) for k, v in values.items()})
    one = spark.createDataFrame([(i,) for i in (7, 1, 3, 2)], "v int")
    assert ranks.medians(one, [], "v").first()["median"] == 2.5 and ranks.medians(one.limit(0), [], "v").first()["median"] is None and ranks.medians(one.limit(0), ["v"], "v").count() == 0


def test_sketches_merge_within_their_bounds(spark):
    rng = random.Random(6)
    rows = [(f"2025-01-{1 + k % 20:02d}", rng.choice("pq"), f"s{int(rng.paretovariate(0.5)) % 20_000}", int(rng.lognormvariate(5, 2)) if k % 9 else None) for k in range(60_000)]
    df = spark.createDataFrame(rows, "date string, project string, who string, ms long")
    told = sketches.rollup(df, ["date", "project"], {"people": F.col("who")}, {"ms": F.col("ms")}, {"n": F.lit(1)})
    for cond, by in (("true", []), ("date <= '2025-01-07'", ["project"]), ("date = '2025-01-03' AND project = 'p'", ["project"])):
        for r in sketches.merged(told.where(cond), by, {"half": 0.5, "most": 0.9}).collect():
            some = [x for x in df.where(cond).collect() if not by or x["project"] == r["project"]]
            exact, values = len({x["who"] for x in some}), sorted(x["ms"] for x in some if x["ms"] is not None)
            assert r["n"] == len(some) and abs(r["people"] - exact) <= max(1, 4 * 1.04 / 2 ** (sketches.BITS / 2) * exact)
            for name, q in (("half", 0.5), ("most", 0.9)):
                v = r[f"ms_{name}"]
                assert sum(x < v for x in values) <= (q + 3 * sketches.RANK) * len(values) + 1 and sum(x <= v for x in values) >= (q - 3 * sketches.RANK) * len(values) - 1
    nothing = sketches.merged(told.where("false"), ["project"], {"half": 0.5})
    assert nothing.count() == 0
    blank = sketches.rollup(df.where("ms IS NULL").limit(3), ["project"], {"people": F.lit(None).cast("string")}, {"ms": F.col("ms")}, {})
    assert {(r["people"], r["ms_half"]) for r in sketches.merged(blank, ["project"], {"half": 0.5}).collect()} == {(0, None)}


def test_a_kept_rollup_replaces_its_days_alone(spark, tmp_path):
    path = str(tmp_path / "rollup")
    make = lambda rows: sketches.rollup(spark.createDataFrame(rows, "date string, project string, who string"), ["date", "project"], {"people": F.col("who")}, {}, {"n": F.lit(1)})
    rollups.write(make([("2025-01-01", "p", "a"), ("2025-01-01", "p", "b"), ("2025-01-02", "p", "c")]), path)
    rollups.write(make([("2025-01-02", "p", "a"), ("2025-01-02", "p", "d"), ("2025-01-03", "q", "a")]), path)
    kept = spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))
    assert [tuple(r) for r in sketches.merged(kept, ["project"]).orderBy("project").collect()] == [("p", 4, 3), ("q", 1, 1)]


def test_differences_count_repeats(spark):
    rng, schema = random.Random(7), "k long, v string"
    draw = lambda n: [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None])) for _ in range(n)]
    a, b = draw(40), draw(60)
    x, y, na, nb = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), Counter(a), Counter(b)
    rows = lambda df: {(r["k"], r["v"]): r["n"] for r in df.collect()}
    assert rows(snapshots.except_all(x, y)) == dict(na - nb) and rows(snapshots.intersect_all(x, y)) == dict(na & nb)
    back = lambda df: Counter(tuple(r) for r in df.collect())
    assert back(x.exceptAll(y)) == na - nb and back(x.intersectAll(y)) == na & nb
    got = {(r["k"], r["v"]): (r["n"], r["change"]) for r in snapshots.changes(x, y, ["k"]).collect()}
    diff = {row: nb[row] - na[row] for row in na | nb if nb[row] != na[row]}
    both = {k for k in (1, 2, 3, None) if {d > 0 for (kk, _), d in diff.items() if kk == k} == {True, False}}
    assert got == {row: (d, ("changed_to" if d > 0 else "changed_from") if row[0] in both else ("added" if d > 0 else "gone")) for row, d in diff.items()}
    assert snapshots.changes(x, x, ["k"]).count() == 0


def test_the_cube_reads_lines_once_and_agrees_with_single_rollups(spark):
    from turnlake.plans import usage
    from turnlake.plans.adapters import Model

    m = Model(spark, "/root/testdata/sf0.001")
    cube = rollups.usage_cube(m)
    assert cube._jdf.queryExecution().optimizedPlan().toString().count("events.parquet") <= 1
    columns = ("api_calls", "sessions", "total_tokens", "tool_uses", "cost_usd")
    took = lambda df, *by: sorted(tuple(r[c] for c in (*by, *columns)) for r in df.collect())
    assert took(cube.where("level = 3"), "date") == took(usage.daily(m), "date")
    overall = cube.where("level = 7").first()
    assert overall["sessions"] == m.messages.select("session_id").distinct().count()
