"""Incremental roll-ups: after each load what is stored is what a full run makes."""

import json
import os

import pytest

from turnlake.plans import behaviour, usage
from turnlake.sources.transcripts import Transcripts
from turnlake.streaming import ingest, refresh

SCHEMA = "value string, file string, byte_offset long, restarted boolean, batch long"


def answer(session, uuid, at, response, tokens, *calls, **more):
    content = [{"type": "text", "text": "x"}] + [{"type": "tool_use", "id": c, "name": "Edit", "input": {}} for c in calls]
    return {"type": "assistant", "uuid": uuid, "sessionId": session, "timestamp": f"2025-{at}Z", "message": {"id": response, "model": "claude-opus-5", "content": content, "usage": {"input_tokens": tokens, "output_tokens": 1}}} | more


def result(session, uuid, at, call, **payload):
    return {"type": "user", "uuid": uuid, "sessionId": session, "timestamp": f"2025-{at}Z", "message": {"content": [{"type": "tool_result", "tool_use_id": call, "content": "ok"}]}, "toolUseResult": payload}


def ask(session, uuid, at, words):
    return {"type": "user", "uuid": uuid, "sessionId": session, "timestamp": f"2025-{at}Z", "promptSource": "typed", "message": {"content": words}}


LOADS = [
    # Three sessions on three days; the call of s1 has no result yet.
    {
        "a": [answer("s1", "b1", "01-01T10:00:00", "r1", 100, "c1"), ask("s1", "p1", "01-01T10:01:00", "go"), answer("s1", "b2", "01-01T10:02:00", "r2", 7)],
        "b": [answer("s2", "d1", "01-02T09:00:00", "r3", 50), {"type": "custom-title", "sessionId": "s2", "customTitle": "t"}],
        "c": [answer("s3", "e1", "01-03T09:00:00", "r4", 9, cwd="/w/late"), answer("s4", "e2", "01-05T09:00:00", "r9", 5)],
    },
    # A late result for s1 from another session's file, a line of r3 with a smaller id in a new session, and a folder for s2.
    {
        "d": [result("s5", "f1", "01-06T08:00:00", "c1", structuredPatch=[{"lines": ["+x", "-y"]}]), answer("s5", "a0", "01-06T08:01:00", "r3", 50)],
        "b": [answer("s2", "d2", "01-02T09:05:00", "r5", 3, cwd="/w/named")],
    },
    # File a is rewritten: b1 and the prompt are gone, and so is the only record of that day of s1 but one; no session and no time.
    {"a!": [answer("s1", "b2", "01-01T10:02:00", "r2", 8)], "e": [{"type": "assistant", "uuid": "z", "message": {"id": "q", "content": "hm"}}, answer(None, "z2", "01-03T01:00:00", None, 2)]},
    # All of file c is gone.
    {"c!": []},
]


def bronze(spark, n):
    rows, size = [], {}
    for batch, files in enumerate(LOADS[:n]):
        for name, lines in files.items():
            path, again = f"/x/projects/dir/{name.rstrip('!')}.jsonl", name.endswith("!")
            if again:
                rows.append((None, path, -1, True, batch))
            new, at = again or path not in size, 0 if again else size.get(path, 0)
            for line in lines:
                rows.append((json.dumps(line), path, at, new, batch))
                at += 1000
            size[path] = at
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


def same(spark, store, n):
    full = Transcripts(spark, "/x", ingest.current(bronze(spark, n)))
    for name in refresh.TABLES:
        made = getattr(full, name)
        assert values(store.table(name).select(*made.columns) if store.read(name) is not None else made.limit(0)) == values(made), name
    assert values(store.table("sessions")) == values(full.sessions)
    assert values(store.table("daily")) == values(usage.daily(full))
    assert values(store.table("session_facts")) == values(behaviour.session_facts(full))


def written(path, name, by="date"):
    """When each day's files were written."""
    top = os.path.join(path, name)
    return {d.split("=")[1]: max(os.stat(os.path.join(top, d, f)).st_mtime_ns for f in os.listdir(os.path.join(top, d))) for d in os.listdir(top) if d.startswith(by)}


def test_loads_equal_full_runs_and_touch_no_other_days(spark, tmp_path):
    path = str(tmp_path / "store")
    store = refresh.Store(spark, path)
    assert set(refresh.refresh(spark, "/x", bronze(spark, 1), path).days) == {"2025-01-01", "2025-01-02", "2025-01-03", "2025-01-05", None}
    same(spark, store, 1)
    before = {name: written(path, name) for name in ("messages", "daily")}
    change = refresh.refresh(spark, "/x", bronze(spark, 2), path)
    # The result touches its call's day, the smaller id the day of the line that was billed before; s3 and s4 stay.
    assert set(change.days) >= {"2025-01-01", "2025-01-02", "2025-01-06"} and not {"2025-01-03", "2025-01-05"} & set(change.days) and change.sessions == 3
    for name in before:
        now = written(path, name)
        assert {d for d in before[name] if now[d] == before[name][d]} == {"2025-01-03", "2025-01-05"}
    same(spark, store, 2)
    assert {r["uuid"]: r["usage_dupe"] for r in store.table("messages").where("message_id = 'r3'").collect()} == {"a0": 0, "d1": 1}
    again = written(path, "messages")
    assert refresh.refresh(spark, "/x", bronze(spark, 2), path) == refresh.Change(1, (), 0) and written(path, "messages") == again


def test_rewritten_files_and_a_run_that_fails_half_way(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store = refresh.Store(spark, path)
    refresh.refresh(spark, "/x", bronze(spark, 2), path)
    put, calls = refresh.Store.put, []

    def failing(self, name, rows, by, days):
        calls.append(name)
        if name == "turns":
            raise OSError("an executor's disk")
        return put(self, name, rows, by, days)

    with monkeypatch.context() as patch:
        patch.setattr(refresh.Store, "put", failing)
        with pytest.raises(OSError):
            refresh.refresh(spark, "/x", bronze(spark, 3), path)
    assert "messages" in calls and store.progress() == (0, 1)
    assert refresh.refresh(spark, "/x", bronze(spark, 3), path).upto == 2
    same(spark, store, 3)
    assert refresh.refresh(spark, "/x", bronze(spark, 4), path).upto == 3
    same(spark, store, 4)
    assert "2025-01-05" not in written(path, "daily") and "2025-01-03" in written(path, "daily")


def test_nothing_to_read_yet(spark, tmp_path):
    path = str(tmp_path / "store")
    empty = spark.createDataFrame([("not json", "/x/projects/dir/a.jsonl", 0, True, 0)], SCHEMA)
    assert refresh.refresh(spark, "/x", empty, path) == refresh.Change(-1, (), 0)
    assert refresh.refresh(spark, "/x", empty.limit(0), path) == refresh.Change(-1, (), 0)


def test_a_load_writes_one_file_a_day_and_days_in_several_tasks(spark, tmp_path):
    lines = [answer(f"s{k}", f"m{k}-{i}", f"0{k % 4 + 1}-{i % 20 + 1:02}T10:00:00", f"r{k}-{i}", 1) for k in range(4) for i in range(40)]
    rows = [(json.dumps(line), f"/x/projects/dir/{line['sessionId']}.jsonl", i, True, 0) for i, line in enumerate(lines)]
    refresh.refresh(spark, "/x", spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path))
    for name in ("records/load=0", "messages", "daily"):
        files = [f for day in (tmp_path / name).glob("date=*") for f in day.glob("*.parquet")]
        assert len(files) == 80
        # The number in a file's name is that of the task: without a number of partitions all days would go to one.
        assert len({f.name.split("-")[1] for f in files}) > 1
