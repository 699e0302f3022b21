import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOCS, rows_of
from tests.llm.test_decontam import brute as brute_contaminated
from tests.llm.test_line_windows import brute as brute_lines
from tests.llm.test_line_windows import split
from tests.llm.test_near_dedup import brute as brute_near
from tests.llm.test_toxicity import LABELS, corpus


def make(spark, top, rows, labels, items):
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")


def test_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = corpus(500)
    item = " ".join(f"bench{k}" for k in range(25))
    passage = "\n".join(f"shared line number {k} of it" for k in range(4))
    rows += [(1000, item), (1001, " ".join(f"filler{k}" for k in range(60)) + " " + item.upper() + " tail"), (1002, f"first {rng.random()}\n{passage}\nthen"), (1003, f"second {rng.random()}\n{passage}\nlast words")]
    near = [f"n{k}" for k in range(300)]
    rows += [(1010 + k, " ".join(["x" + str(k) if j == 40 * k else w for j, w in enumerate(near)])) for k in range(5)] + [(1020, None), (1021, "")]
    make(spark, tmp_path, rows, labels, [(1, item), (2, None)])

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = (before, {r["doc_id"]: r for r in docs.collect()})
        assert name == "mixing" or docs.columns == columns

    before, after = seen["toxicity"]
    toxic = {i for i, _, t in labels if t}
    assert len((before.keys() - after.keys()) ^ toxic) <= 4
    before, after = seen["line_dedup"]
    assert {i: split(r["text"] or "") for i, r in after.items()} == {i: stay for i, (stay, _) in brute_lines(list(before.items())).items()}
    assert after[1003]["n_chars"] == len(after[1003]["text"]) < after[1002]["n_chars"]
    before, after = seen["near_dedup"]
    assert after.keys() == {i for i, _, _, kept in brute_near(list(before.items()), 5) if kept}
    before, after = seen["decontamination"]
    assert before.keys() - after.keys() == {i for i, *_, bad in brute_contaminated(list(before.items()), [(1, item)]) if bad} == {1000, 1001}
    before, after = seen["mixing"]
    assert all(0 < r["taken"] <= 3 * r["size"] for r in after.values()) and after.keys() <= before.keys()


def test_run_gives_the_last_stage_and_takes_empty_tables(spark, tmp_path):
    rows, labels = corpus(120)
    make(spark, tmp_path / "a", rows, labels, [(1, "x y z")])
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).columns[-1] == "taken"
    make(spark, tmp_path / "b", [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_four_or_five_named_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_columns_that_clash_with_those_of_operators(spark, tmp_path):
    rows, labels = corpus(60)
    make(spark, tmp_path, rows, labels, [(1, "x y z")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({"taken": F.lit("t"), "Size": F.lit(1), "target": F.lit(2.0), "kept": F.lit(3), "node": F.lit(4), "of_doc": F.lit(5)})
    docs.write.parquet(f"{tmp_path}/more/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/more/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/more")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "node", "of_doc", "size", "source_size", "target", "taken"]
    assert rows_of(out, "doc_id", "taken") == rows_of(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "taken")


def test_stages_keep_columns_that_differ_only_in_case(spark, tmp_path):
    rows, labels = corpus(40)
    make(spark, tmp_path, rows, labels, [(1, "x y z")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnsRenamed({"lang": "Doc_ID"})
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[:5] == ["doc_id", "text", "Doc_ID", "source", "n_chars"], name
    assert docs.count() > 0
