import hashlib
import random
import re

from tests.llm.conftest import DOCS, rows_of
from turnlake.llm import exact_dedup


def brute(rows):
    body = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    out = []
    for i, t in rows:
        group = [(-len(u or ""), j is None, j if j is not None else 0, j) for j, u in rows if body[j] == body[i]]
        keep = min(group)[3]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(body[i].encode()).hexdigest()))
    return out


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_matches_brute_force_on_nulls_empty_long_and_tied_texts(docs):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta,", "gamma.", "δέλτα"]) for _ in range(4000))
    rows = [(1, None), (2, ""), (3, " \t\x0b\x0c\r\n"), (4, "a b c"), (5, "abc"), (6, "ab c"), (7, "a\u00a0bc"), (8, long), (9, long.replace(" ", "\n\n")), (10, long + "x"), (11, "x" * 9000), (12, "x" * 9000 + " "), (None, "lone"), (13, "😀" * 700)]
    got = rows_of(exact_dedup.dedup(docs(*rows)).select(*COLUMNS))
    assert got == sorted(brute(rows), key=lambda t: tuple((x is not None, x) for x in t))


def test_chunks_are_content_defined_and_complete(spark):
    text = "".join(f"word{i}{'.' if i % 9 == 0 else ''}" for i in range(2000))
    cut, moved = (r[0] for r in spark.createDataFrame([(text,), ("X." + "y" * 254 + "." + text,)], "t string").select(exact_dedup.chunks("t")).collect())
    assert "".join(cut) == text and all(len(c) <= exact_dedup.MOST for c in cut)
    assert len(set(cut) & set(moved)) > len(cut) / 2


def test_a_shared_identifier_is_found(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    both = docs((1, "one"), (2, "two"))
    assert exact_dedup.collisions(both, 0).count() == 0
    monkeypatch.setattr(exact_dedup, "identifier", lambda chunk, seed: F.array(F.lit(7 + 0 * seed), F.lit(7)) if seed == 0 else F.array(F.xxhash64(chunk), F.lit(seed)))
    assert exact_dedup.collisions(both, 0).count() == 1
    assert {r["keep_id"] for r in exact_dedup.dedup(both).collect()} == {1, 2}


def test_empty_table_and_clashing_columns(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, "a", True, "z", 3), (2, "a ", False, "y", 4)], "doc_id long, text string, kept boolean, TEXT string, keep_id int")
    assert rows_of(exact_dedup.dedup(odd), "doc_id", "keep_id", "group_size", "kept") == [(1, 2, 2, False), (2, 2, 2, True)]


def test_repeated_rows_count_each(docs):
    got = rows_of(exact_dedup.dedup(docs((1, "a"), (1, "a"), (2, "a"))), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False)]
