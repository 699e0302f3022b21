"""Arrow operators on tasks without a single word, each in a Python worker that has seen nothing before."""

import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.python.worker.reuse", "false").config("spark.sql.shuffle.partitions", "3")
    .config("spark.sql.adaptive.enabled", "false").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import pyspark.sql.functions as F
from turnlake.llm import {modules}
FULL = " ".join(f"w{{i % 7}}" for i in range(120))
# A task, and so a worker, for each text.
for texts in ([None, "", " \\t\\n "], [FULL, "", FULL]):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartitionByRange(len(texts), "doc_id")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.col("text").alias("html"))
    for f in ({calls}):
        assert f().count() == len(texts)
print("passed")
"""


def run(tmp_path, modules, *calls):
    script = SCRIPT.format(modules=modules, calls=", ".join(f"lambda: {c}" for c in calls) + ",")
    done = subprocess.run([sys.executable, "-c", script, str(tmp_path)], cwd=TOP, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and "passed" in done.stdout, done.stderr[-3000:]


def test_texts_without_words(tmp_path):
    run(tmp_path, "line_windows, periodic, substring", "line_windows.report(docs)", "line_windows.clean(docs)", "substring.report(docs)", "periodic.report(docs)")


def test_other_operators(tmp_path):
    run(tmp_path, "near_dedup, toxicity, warc", "near_dedup.groups(docs)", "toxicity.report(docs, labels)", "warc.report(pages)")
