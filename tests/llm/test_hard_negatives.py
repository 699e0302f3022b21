import math
import random

import numpy as np
import pytest

from tests.llm.conftest import rows_of
from turnlake.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows):
    kept = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, row), row)
    width = max((len(v) for _, v in kept.values()), default=0)
    v = {i: row[1] + [0] * (width - len(row[1])) for i, row in kept.items()}
    score = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    out = []
    for a in (i for i in kept if i % 100 == 0):
        order = sorted((-score(a, b), b) for b in kept if b != a)
        for minus, p in [x for x in order if kept[x[1]][0] == kept[a][0]][:5]:
            fit = [(s, b) for s, b in ((-m, b) for m, b in order) if kept[b][0] != kept[a][0] and 30 * -minus <= 100 * s <= 90 * -minus]
            out += [(a, p, r, b, -minus, s) for r, (s, b) in enumerate(fit[:10], 1)]
    return sorted(out)


def generated(rng, n, width=12, labels=4, ids=lambda k: k):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels * 2)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        rows.append((ids(k), [x * 0.3 + rng.gauss(0, 0.2) for x in c], rng.randrange(labels)))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = generated(rng, 900, ids=lambda k: k * 5)
    out = rows_of(hard_negatives.report(spark.createDataFrame(rows, SCHEMA)), *COLUMNS)
    assert out == brute(rows) and len(out) > 500


def test_coarse_cells_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = generated(rng, 600, ids=lambda k: k * 4)
    monkeypatch.setattr(hard_negatives, "CELLS", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    assert rows_of(hard_negatives.report(spark.createDataFrame(rows, SCHEMA).repartition(7)), *COLUMNS) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v = rng.integers(-500, 500, (300, 9))
    marks = [np.unique(np.quantile(v[:, d], [0.1, 0.5, 0.7]).astype(np.int64)) for d in range(9)]
    ends = [np.unique(np.append(m, v[:, d].max())) for d, m in enumerate(marks)]
    low, high = np.zeros((9, 256)), np.zeros((9, 256))
    for d, e in enumerate(ends):
        high[d, : len(e)], low[d, : len(e)] = e, np.append(v[:, d].min(), e[:-1] + 1)
    cells = hard_negatives.Cells(ends, low, high, np.abs(v).max(0))
    a = v[:40].astype(float)
    lower, upper = cells.bounds(cells.codes(v), np.maximum(a, 0), np.minimum(a, 0))
    exact = v @ v[:40].T
    assert (lower <= exact).all() and (exact <= upper).all() and (lower < exact).mean() > 0.9


def test_one_label_with_most_rows_and_one_vector_many_times(spark):
    rng = random.Random(4)
    same = [round(rng.gauss(0, 0.3), 2) for _ in range(8)]
    rows = [(k, same, 1) for k in range(0, 300)] + generated(rng, 300, 8, 3, ids=lambda k: 1000 + k)
    assert rows_of(hard_negatives.report(spark.createDataFrame(rows, SCHEMA)), *COLUMNS) == brute(rows)


def test_nulls_repeats_and_odd_rows(spark):
    nan, inf, v = float("nan"), float("inf"), [0.5, 0.25, -0.5]
    rows = [
        (0, v, 1), (100, [0.1, 0.2, 0.3], 2), (200, None, 1), (300, v, None), (None, v, 1), (1, [nan, 0.0, 0.0], 1), (2, [inf, 0.0, 0.0], 2), (3, [None, 0.1, 0.2], 2), (4, [0.5, 0.2, -0.4], 1), (4, [0.5, 0.2, -0.4], 1),
        (5, [0.4, 0.1], 2), (6, [], 2), (8, [0.3, 0.2, -0.2], 2), (8, [0.2, 0.2, -0.2], 3), (9, [0.4, 0.2, -0.5], 1), (10, [0.3, 0.1, -0.3], 3), (14, [0.3, 0.1, -0.3], 9), (15, [-0.5, -0.25, 0.5], 4), (400, [-0.5, 0.0, 0.0], 1),
    ]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS row", "3 AS LABEL2", "4 AS vector")
    out = rows_of(hard_negatives.report(table), *COLUMNS)
    assert out == brute(rows) and out
    assert hard_negatives.report(table.limit(0)).count() == 0
    assert hard_negatives.report(spark.createDataFrame([(100, None, None)], SCHEMA)).count() == 0


def test_large_components_are_exact_or_refused(spark):
    rng = random.Random(5)
    wide = "vec_id long, embedding array<double>, label int"
    rows = [(k * 10, [rng.choice([-1, 1]) * rng.random() * 2.0**20 for _ in range(4)], k % 2) for k in range(60)]
    kept = {i: ((lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows}
    for r in hard_negatives.report(spark.createDataFrame(rows, wide)).collect():
        assert r["negative_score"] == sum(x * y for x, y in zip(kept[r["anchor_id"]][1], kept[r["negative_id"]][1]))
    with pytest.raises(ValueError):
        hard_negatives.report(spark.createDataFrame([(0, [2.0**40], 1), (1, [1.0], 1)], wide)).count()
