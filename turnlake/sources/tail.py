"""Appended JSON lines as a stream: only whole new lines, from where the last batch ended.

The built-in file stream takes each file once and misses what is appended to it
later. This source keeps an offset for each file instead: its consumed bytes
and a fingerprint of its first bytes, so that a file that was rewritten is read
from its start. A last line without its line feed waits for the next batch.
Rows of a batch that read a file from its start say so (``restarted``); of a
file that was rewritten a row without a value comes besides, so that readers
learn of it even if the file has no lines any more.
Files must be where the driver and the executors reach them by path.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes at a file's start that tell whether it is still the same file, and bytes that one task reads at most.
HEAD, PIECE = 256, 64 << 20


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int, restarted: bool = False, rewritten: bool = False):
        self.path, self.start, self.end, self.restarted, self.rewritten = path, start, end, restarted, rewritten


def fingerprint(path: str, size: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha1(f.read(min(HEAD, size))).hexdigest()


def last_line_end(path: str, start: int, end: int) -> int:
    """Where the last whole line before ``end`` ends; ``start`` if there is none."""
    with open(path, "rb") as f:
        at = end
        while at > start:
            step = min(1 << 16, at - start)
            f.seek(at - step)
            k = f.read(step).rfind(b"\n")
            if k >= 0:
                return at - step + k + 1
            at -= step
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, top: str, suffix: str):
        self.top, self.suffix = top, suffix

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        files = {}
        for folder, _, names in os.walk(self.top):
            for name in sorted(names):
                if name.endswith(self.suffix):
                    path = os.path.join(folder, name)
                    size = last_line_end(path, 0, os.path.getsize(path))
                    files[path] = [size, min(size, HEAD), fingerprint(path, size)]
        return {"files": json.dumps(files, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before, out = json.loads(start["files"]), []
        for path, (size, _, _) in json.loads(end["files"]).items():
            consumed, head, mark = before.get(path, [0, 0, ""])
            same = consumed and consumed <= size and fingerprint(path, head) == mark
            at = consumed if same else 0
            if consumed and not same:
                out.append(Span(path, 0, 0, True, True))
            while at < size:
                # Pieces end at line ends; a line longer than a piece is one of its own.
                to = last_line_end(path, at, min(at + PIECE, size)) if at + PIECE < size else size
                to = to if to > at else size
                out.append(Span(path, at, to, not same))
                at = to
        return out or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.rewritten:
            yield (None, partition.path, -1, True)
        if partition.end > partition.start:
            with open(partition.path, "rb") as f:
                f.seek(partition.start)
                at = partition.start
                while at < partition.end:
                    line = f.readline()
                    if not line:
                        break
                    text = line.decode("utf-8", "replace").rstrip("\r\n")
                    if text.strip():
                        yield (text, partition.path, at, partition.restarted)
                    at += len(line)


class TailSource(DataSource):
    """Options: path (a folder), suffix (.jsonl unless given)."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "value string, file string, byte_offset long, restarted boolean"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"))


def stream(spark: SparkSession, path: str):
    """New lines of all files under ``path``: value, file, byte_offset, restarted."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("jsonl_tail").option("path", path).load()
