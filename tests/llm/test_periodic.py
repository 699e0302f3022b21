import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import rows_of
from turnlake.llm import periodic
from turnlake.llm.word_hashes import WordHashes

BLANKS = " \t\n\x0b\x0c\r"


def split(text):
    for c in BLANKS:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(words, least=12):
    """Runs of a list, by a walk along every distance."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = []
    for i, t in rows:
        w = planted(i, split(t))
        runs = sorted(brute(w), key=lambda r: (r[0], r[2]))
        gone = {p for s, n, q in runs for p in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) + () if runs else (None, None, None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(told), digest(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def generated(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 20]), rng.randrange(0, 120)
    w = [f"{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 3:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, n - a))
            for i in range(a + p, rng.randrange(a, n) + 1):
                w[i] = w[i - p]
    if rng.random() < 0.2:
        x, y = ["a"], ["a", "b"]
        while len(y) < n:
            x, y = y, y + x
        w = y[:n]
    return w


@pytest.mark.parametrize("least", [4, 7, 12])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(500):
        texts = [generated(rng) for _ in range(rng.randrange(1, 5))]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        got = periodic.runs_of([w.encode() for t in texts for w in t], bounds, WordHashes(), least)
        assert got == sorted((s + int(b), n, q) for t, b in zip(texts, bounds) for s, n, q in brute(t, least))


def test_previous_factors_and_blocks():
    symbols = np.array([1, 2, 1, 2, 1, 3, 1, 2, 9])
    factors, sources = periodic.previous_factors(periodic.doubled(symbols))
    assert factors.tolist() == [0, 0, 3, 2, 1, 0, 2, 1, 0]
    assert [sources[i] for i in (2, 3)] == [0, 1] and sources[6] in (0, 2)
    assert periodic.blocks(factors).tolist() == [0, 1, 2, 5, 6, 8, 9]


def test_report_against_brute_force(docs):
    rng = random.Random(1)
    rows = [(i, rng.choice(BLANKS).join(generated(rng))) for i in range(150)] + [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(300))) for i in range(150, 260)]
    out = rows_of(periodic.report(periodic.planted(docs(*rows))), *COLUMNS)
    assert out == expected(rows) and sum(r[1] for r in out) > 50


def test_a_run_keeps_its_first_period(docs):
    rows = [(1, "start " + "a b c " * 5 + "end"), (2, "x " * 12), (3, "x " * 11), (4, "a b " * 6 + "a"), (5, "é ü " * 7)]
    found = {r["doc_id"]: r for r in periodic.found_runs(docs(*rows)).collect()}
    assert [tuple(r) for r in found[1]["runs"]] == [(1, 15, 3)] and found[1]["collapsed"] == "start a b c end"
    assert [tuple(r) for r in found[2]["runs"]] == [(0, 12, 1)] and found[2]["collapsed"] == "x"
    assert found[3]["runs"] == [] and found[3]["collapsed"] == " ".join("x" * 11)
    assert [tuple(r) for r in found[4]["runs"]] == [(0, 13, 2)] and found[5]["collapsed"] == "é ü"


def test_nulls_repeats_clashing_columns_and_empty_tables(docs):
    loop = "la di da " * 6
    rows = [(None, loop), (1, None), (2, ""), (3, " \n\t"), (7, loop), (7, loop), (7, "other")]
    table = docs(*rows).selectExpr("*", "1 AS runs", "2 AS TEXT", "3 AS words", "4 AS h", "5 AS collapsed")
    assert rows_of(periodic.report(periodic.planted(table)), *COLUMNS) == expected(rows)
    assert periodic.report(periodic.planted(table.limit(0))).count() == 0
    assert rows_of(periodic.report(periodic.planted(docs((5, None)))), *COLUMNS) == expected([(5, None)])


def test_long_texts(docs):
    rng = random.Random(2)
    part = [f"w{rng.randrange(900)}" for _ in range(3000)]
    rows = [(1, "ha " * 150_000), (2, " ".join(part * 50)), (3, " ".join(f"w{rng.randrange(2)}" for _ in range(100_000)))]
    found = {r["doc_id"]: r for r in periodic.found_runs(docs(*rows)).collect()}
    assert [tuple(r) for r in found[1]["runs"]] == [(0, 150_000, 1)]
    assert [tuple(r) for r in found[2]["runs"]] == [(0, 150_000, 3000)] and found[2]["collapsed"] == " ".join(part)
    assert len(found[3]["runs"]) > 500
