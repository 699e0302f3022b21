"""Batches of new lines by Spark's file source."""

import os

import pytest

from turnlake.sources import appended
from turnlake.streaming import ingest


@pytest.fixture
def logs(tmp_path):
    top = tmp_path / "home" / "projects" / "dir one"
    top.mkdir(parents=True)
    clock = [1_700_000_000]

    def write(name, text, mode="w"):
        with open(top / name, mode, newline="") as f:
            f.write(text)
        clock[0] += 10
        os.utime(top / name, (clock[0], clock[0]))

    return write, str(tmp_path / "home"), str(tmp_path / "bronze")


def batch(spark, bronze, number):
    rows = spark.read.parquet(f"{bronze}/batch={number}").collect()
    return sorted(((r["file"].rpartition("/")[2], r["byte_offset"], r["value"], r["restarted"]) for r in rows), key=str)


def test_lines_come_once_and_whole(spark, logs):
    write, home, bronze = logs
    write("a.jsonl", '{"n":1}\n{"n":2}\n\n{"n":')
    write("b.jsonl", "bé\r\n")
    write("note.txt", "no\n")
    assert ingest.append(spark, home, bronze) == 0
    assert batch(spark, bronze, 0) == [("a.jsonl", 0, '{"n":1}', True), ("a.jsonl", 8, '{"n":2}', True), ("b.jsonl", 0, "bé", True)]
    assert ingest.append(spark, home, bronze) == -1
    write("a.jsonl", '3}\n{"n":4}\n', "a")
    write("c.jsonl", "")
    assert ingest.append(spark, home, bronze) == 1
    assert batch(spark, bronze, 1) == [("a.jsonl", 17, '{"n":3}', False), ("a.jsonl", 25, '{"n":4}', False)]
    write("c.jsonl", "first\n")
    assert ingest.append(spark, home, bronze) == 2 and batch(spark, bronze, 2) == [("c.jsonl", 0, "first", True)]


def test_rewritten_files_start_over(spark, logs):
    write, home, bronze = logs
    write("a.jsonl", "one\ntwo\n")
    write("b.jsonl", "one\ntwo\n")
    write("c.jsonl", "one\ntwo\n")
    ingest.append(spark, home, bronze)
    write("a.jsonl", "ONE\ntwo\nthree\n")  # another first line
    write("b.jsonl", "one\nTWO\nthree\n")  # another line where it was left
    write("c.jsonl", "")
    ingest.append(spark, home, bronze)
    told = batch(spark, bronze, 1)
    assert [r for r in told if r[0] == "a.jsonl"] == [("a.jsonl", -1, None, True), ("a.jsonl", 0, "ONE", True), ("a.jsonl", 4, "two", True), ("a.jsonl", 8, "three", True)]
    assert len([r for r in told if r[0] == "b.jsonl"]) == 4 and not [r for r in told if r[0] == "c.jsonl"]
    write("c.jsonl", "new\n")
    ingest.append(spark, home, bronze)
    assert batch(spark, bronze, 2) == [("c.jsonl", -1, None, True), ("c.jsonl", 0, "new", True)]
    now = ingest.current(spark.read.parquet(bronze)).collect()
    assert sorted(r["value"] for r in now) == ["ONE", "TWO", "new", "one", "three", "three", "two"]


def test_places_are_right_whatever_the_split(spark, logs):
    write, home, bronze = logs
    lines = [f"{k}:" + "é" * (k * 37 % 400) for k in range(3000)]
    write("big.jsonl", "".join(x + "\n" for x in lines[:2000]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        ingest.append(spark, home, bronze)
        write("big.jsonl", "".join(x + "\n" for x in lines[2000:]), "a")
        ingest.append(spark, home, bronze)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    at, want = 0, []
    for x in lines:
        want.append((at, x))
        at += len(x.encode()) + 1
    both = [sorted((r["byte_offset"], r["value"]) for r in spark.read.parquet(f"{bronze}/batch={n}").collect()) for n in (0, 1)]
    assert both == [want[:2000], want[2000:]]


def test_a_run_that_failed_is_repeated(spark, logs, monkeypatch):
    write, home, bronze = logs
    write("a.jsonl", "one\n")
    ingest.append(spark, home, bronze)
    write("a.jsonl", "two\n", "a")
    real = appended.new_lines
    with monkeypatch.context() as patch:
        patch.setattr(appended, "new_lines", lambda *a: (real(*a)[0], spark.range(1).selectExpr("raise_error('lost') AS file")))
        with pytest.raises(Exception, match="lost"):
            ingest.append(spark, home, bronze)
    assert ingest.append(spark, home, bronze) == 1 and batch(spark, bronze, 1) == [("a.jsonl", 4, "two", False)]
