"""Streaming usage and tool calls: any order of arrival gives the batch's result, and the state shrinks again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnlake.operators import spans
from turnlake.plans import usage
from turnlake.sources.transcripts import Transcripts
from turnlake.streaming import live

SCHEMA = "value string, file string, byte_offset long"


def made(rng):
    """Lines of three days: responses over several lines and sessions, lines that come again, calls with late, repeated and missing results."""
    rows, place = [], {}
    add = lambda file, **line: (place.update({file: place.get(file, 0) + 100}), rows.append((json.dumps(line), f"/x/projects/d/{file}.jsonl", place[file])))
    at = lambda k: f"2025-05-0{1 + k % 3}T{k % 24:02d}:00:0{k % 10}Z"
    for k in range(40):
        file, response = f"f{k % 4}", f"r{rng.randrange(15)}" if k % 9 else None
        uuid = f"u{rng.randrange(30):02d}" if k % 13 else None
        if uuid and any(f'"{uuid}"' in r[0] for r in rows):
            before = next(json.loads(r[0]) for r in rows if f'"{uuid}"' in r[0])
            response = before["message"]["id"]  # a line that comes again belongs to the same response
        content = [{"type": "tool_use", "id": f"c{k}", "name": "Edit", "input": {}}] if k % 2 else []
        tokens = 10 if uuid is None else rng.randrange(100)
        add(file, type="assistant", uuid=uuid, sessionId=f"s{k % 5}", timestamp=at(k), message={"id": response, "model": "claude-opus-5", "content": content, "usage": {"input_tokens": tokens, "cache_creation_input_tokens": 5, "output_tokens": k % 3}})
        for again in range(rng.randrange(3) if k % 2 else 0):
            block = {"type": "tool_result", "tool_use_id": f"c{k}", "content": "ok", "is_error": again == 1}
            add(f"f{(k + again) % 4}", type="user", uuid=f"x{k}-{again}", sessionId="s9", timestamp=at(k + again), message={"content": [block]}, toolUseResult={"structuredPatch": [{"lines": ["+a"] * (again + 1)}]})
    return rows


def run(spark, tmp_path, parts, changes_of, **limits):
    own = live.session(spark)
    inbox = str(tmp_path / "in")
    last = None
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        stream = own.readStream.schema(SCHEMA).parquet(inbox)
        query = live.start(changes_of(stream, **limits), str(tmp_path / "out"), str(tmp_path / "marks"))
        query.awaitTermination()
        last = query.lastProgress
    return spark.read.schema(changes_of(stream).schema).parquet(str(tmp_path / "out")), last


def values(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = made(rng)
    batch = Transcripts(spark, "/x", spark.createDataFrame(rows, SCHEMA))
    rng.shuffle(rows)
    parts = [rows[k::3] for k in range(3)]
    got, _ = run(spark, tmp_path / "u", parts, live.usage_changes)
    by_day = usage.daily(batch).select("date", "api_calls", "sessions", "input_tokens", "output_tokens", "cache_write", "cache_read", "total_tokens", "cost_usd", "tool_uses")
    assert values(live.usage(got, "date")) == values(by_day)
    got, _ = run(spark, tmp_path / "c", parts, live.call_changes)
    calls = batch.tools.groupBy("date", "session_id", "name").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.col("has_result").cast("long")).alias("completed"), F.sum(F.col("is_error").cast("long")).alias("errors"), F.sum(F.col("interrupted").cast("long")).alias("interrupted"),
        F.sum(F.col("lines_added").cast("long")).alias("lines_added"), F.sum(F.col("lines_removed").cast("long")).alias("lines_removed"), F.sum(F.coalesce("latency_ms", F.lit(0))).alias("latency_ms"),
    )
    assert values(live.calls(got, "date", "session_id", "name")) == values(calls)


def line(k, at):
    return (json.dumps({"type": "assistant", "uuid": f"u{k}", "sessionId": "s", "timestamp": at, "message": {"id": f"r{k}", "model": "m", "content": [], "usage": {"input_tokens": 1}}}), "/x/projects/d/f.jsonl", k)


def test_the_state_forgets(spark, tmp_path):
    old = [line(k, "2025-05-01T00:00:00Z") for k in range(30)]
    new = [[line(100 + d, f"2025-05-{d:02d}T00:00:00Z")] for d in (10, 11)]
    got, progress = run(spark, tmp_path, [old, *new], live.usage_changes, late="1 day", kept=2 * 86_400_000)
    state = progress["stateOperators"][0] if isinstance(progress, dict) else progress.stateOperators[0]
    rows = state["numRowsTotal"] if isinstance(state, dict) else state.numRowsTotal
    assert rows < 30 and live.usage(got, "date").count() == 3


def test_active_spans_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Lines come in any order within the watermark's reach; a span is appended when nothing can lengthen it."""
    rng, schema = random.Random(5), "session_id string, s long, tokens long"
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(0, 40_000), rng.randrange(9)) for _ in range(120)]
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    batch = spans.active(timed(spark.createDataFrame(rows, schema)), "5 minutes")
    rng.shuffle(rows)
    out, inbox = str(tmp_path / "out"), str(tmp_path / "in")
    for part in (rows[::2], rows[1::2], [("end", 10**6, 0)], [("end", 2 * 10**6, 0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = timed(spark.readStream.schema(schema).parquet(inbox)).withWatermark("ts", "1 day")
        spans.active(stream, "5 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "marks")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(batch.schema).parquet(out).where("session_id IS NULL OR session_id <> 'end'")
    assert values(got) == values(batch) and batch.count() > 60
