"""WARC archives: writing captures, and assembling transactions read back.

Each capture is written as three records, a request, a response (or a revisit)
and metadata; request and metadata name the response by WARC-Concurrent-To, and
a revisit its response by WARC-Refers-To. Reading finds the records and joins
the three of each transaction to one nested row.

Archives are written by Spark's text writer and read by its text reader, so
they may be on any file system that Spark reaches. A record is a text (headers,
line feeds, UTF-8 payload) and the writer adds the two empty lines that end it.
The reader splits files where such lines and the next record's version stand, so
plain files are read by several tasks. A payload may hold that separator itself.
A first pass therefore takes the head and length of each piece, and a walk over
each file's heads finds the records that span several pieces, wherever tasks
part the file. Those pieces are dealt out by record, in order, and put together;
all others are a record each and stay where they are read. Whatever its length,
of a record one piece is held at a time, and its payload only if it is asked for.

Archives of others are read, too: gzipped by record or whole, with payload
digests of other algorithms, with records that are no HTTP (dns, warcinfo),
with fields missing. What can't be read as a record is a row with an error
beside the others; reading goes on with the next record.

Of records with equal payloads of at least 100 bytes the one with the smallest
page_id is the response (all of them, should that id repeat); the others are
revisits that refer to it and hold no payload. Defined results: a null html is
an empty payload, a null url an empty target; null page_ids come last, and are
nobody's response while another id has the payload; repeated rows are written
each, rows that are equal in all three columns under the same record ids; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import cut, fitting, new_path, pick

#: Bytes from which an equal payload is a revisit.
LEAST_BYTES = 100
#: Payload bytes in a file, about, and records in a file, at most.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 3000
CRLF = "\r\n"
#: Bytes at the end of a file that may be line ends behind its last record.
ENDS = 4096
#: What ends a record and begins the next.
SEPARATOR = CRLF + CRLF + "WARC/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A date that does not depend on the run; callers with capture times give a column.
DATE = "2024-01-01T00:00:00Z"

#: Columns of a record that was read: name, type, and WARC header where it is one as it stands.
FIELDS = (
    ("record_id", "string", "warc-record-id"), ("type", "string", "warc-type"), ("concurrent_to", "string", "warc-concurrent-to"), ("refers_to_record", "string", "warc-refers-to"),
    ("refers_to", "string", "x-refers-to-page-id"), ("target", "string", "warc-target-uri"), ("page_id", "string", "x-page-id"), ("date", "string", "warc-date"), ("content_type", "string", "content-type"),
    ("http_status", "string", None), ("payload_bytes", "long", None), ("payload_digest", "string", None), ("stated_digest", "string", "warc-payload-digest"), ("digest_ok", "boolean", None),
    ("payload", "binary", None), ("file", "string", None), ("error", "string", None),
)
RECORD = ", ".join(f"{name} {kind}" for name, kind, _ in FIELDS)
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def captures(pages: DataFrame, keep_all_from: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Pages with digest and the page they revisit, and the table of first ids that decides it."""
    rows = pick(pages, "page_id", "url", "html").select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n_bytes"),
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"),
    )
    # Only digests, urls and ids are grouped; a payload moves once, to its digest's first id.
    # Written, so that the join below deals both sides out anew and Spark can split a frequent payload among tasks.
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    firsts = cut(rows.where(F.col("n_bytes") >= keep_all_from).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("sum_bytes")), "firsts")
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    return rows.join(firsts.select("digest", "first"), "digest", "left").withColumn("revisits", revisits), firsts


def _urn(kind: str, page: Column, url: Column) -> Column:
    """An id of a record, the same on every run."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("")), "digest", url))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column, urn: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    fields = [F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in headers]
    length = F.octet_length(block).cast("string")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), urn, F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}"),
        *[F.coalesce(f, F.lit("")) for f in fields], F.lit("Content-Length: "), length, F.lit(CRLF + CRLF), block,
    )


def records(rows: DataFrame) -> DataFrame:
    """The three records of each capture as texts, without the empty lines that end them.

    A header whose value is null is left out.
    """
    page, url, of = F.col("page_id"), F.col("url"), F.col("revisits")
    response, revisit = _urn("response", page, url), of.isNotNull()
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    target = ("WARC-Target-URI", url)
    request = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    facts = F.concat(F.lit("payload-bytes: "), F.col("n_bytes").cast("string"), F.lit(CRLF))
    earlier = [
        ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, _urn("response", of["page_id"], of["url"]))), ("WARC-Refers-To-Target-URI", of["url"]),
        ("WARC-Refers-To-Date", F.when(revisit, DATE)), ("X-Refers-To-Page-ID", of["page_id"].cast("string")),
    ]
    all_three = F.array(
        _record(F.lit("request"), _urn("request", page, url), [target, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http;msgtype=request"))], request),
        _record(
            F.when(revisit, "revisit").otherwise("response"), response,
            [target, ("X-Page-ID", page.cast("string")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), *earlier, ("Content-Type", F.lit("application/http;msgtype=response"))],
            F.when(revisit, head).otherwise(F.concat(head, "html")),
        ),
        _record(F.lit("metadata"), _urn("metadata", page, url), [target, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], facts),
    )
    return rows.select(F.explode(all_three).alias("value"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """WARC files under ``path``, gzipped, of about ``file_bytes`` payload bytes and at most ``records_per_file`` records each."""
    rows, firsts = captures(pages)
    n, held = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("sum_bytes"), F.lit(0))).first()
    # A capture is three records.
    most = max(1, min(records_per_file, 3 * file_bytes * n // held)) if held else records_per_file
    records(rows).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def headers_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name, of repeated ones the first; lines that begin with a blank go on with the one before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split(CRLF)[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        out.setdefault(last, value.strip())
    return out


def _needed(head: bytes) -> int | None:
    """The content length that a head states."""
    said = headers_of(head).get("content-length", "")
    return int(said) if said.isascii() and said.isdigit() else None


def _parts(piece: bytes) -> tuple[bytes, bytes, int] | str:
    """Head, block and length of the block; or why there is no record."""
    head, blank, block = piece.partition(b"\r\n\r\n")
    if not blank or not head[:1].isdigit():
        return "no head"
    need = _needed(head)
    return "no content length" if need is None else (head, block, need)


def spanning(sizes: np.ndarray, trails: np.ndarray, heads: np.ndarray, needs: np.ndarray) -> list[tuple[int, int]]:
    """First piece and the one behind the last of each record that spans several pieces of a file.

    By piece: bytes, line ends at its end, bytes of its head (with the blank
    line), and the length that the head states, negative if it is none.
    """
    upto = np.cumsum(sizes + len(SEPARATOR))
    out, at = [], 0
    while at < len(sizes):
        end = at + 1
        if needs[at] >= 0 and needs[at] > sizes[at] - heads[at]:
            # Where the block ends: in the first piece up to which there are bytes enough.
            last = int(np.searchsorted(upto, upto[at] - len(SEPARATOR) - sizes[at] + heads[at] + needs[at] + len(SEPARATOR)))
            if last < len(sizes):
                over = upto[last] - len(SEPARATOR) - (upto[at] - len(SEPARATOR) - sizes[at]) - heads[at] - needs[at]
                if over <= trails[last]:
                    out.append((at, last + 1))
                    end = last + 1
        at = end
    return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: heads of pieces, by file in order, to the pieces of records that span several."""
    rows, of = [], None

    def told() -> Iterator[pa.RecordBatch]:
        sizes, trails, heads, needs = (np.array(x, np.int64) for x in zip(*(r[2:] for r in rows)))
        found = [(of, *rows[k][:2], first) for first, behind in spanning(sizes, trails, heads, needs) for k in range(first, behind)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["file", "block", "k", "record"])

    for batch in batches:
        for file, block, k, size, end, head in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "k", "size", "end", "head"))):
            if file != of and rows:
                yield from told()
                rows = []
            of = file
            need = _needed(head) if head is not None else None
            rows.append((block, k, size, len(end or b"") - len((end or b"").rstrip(b"\r\n")), len(head or b"") + 4, -1 if need is None else min(need, 1 << 60)))
    if rows:
        yield from told()


def _algorithm(stated: str | None):
    """A hash of the algorithm that a stated digest (``algorithm:value``) names; none for those not known here."""
    name, _, value = (stated or "").partition(":")
    name = name.lower().replace("-", "")
    return hashlib.new(name) if name in ("md5", "sha1", "sha256", "sha512") and value else None


def _agrees(stated: str | None, h) -> bool | None:
    """Whether a stated digest, in hex or base 32, is the one that was worked out; null for algorithms not known here."""
    if h is None:
        return None
    value, plain = stated.partition(":")[2].lower(), base64.b32encode(h.digest()).decode().lower()
    return value in (h.hexdigest(), plain, plain.rstrip("="))


def _sha256(stated: str | None) -> str | None:
    """A stated SHA-256 as bare lower-case hex."""
    name, _, value = (stated or "").partition(":")
    if name.lower() not in ("sha256", "sha-256"):
        return None
    if len(value) == 64:
        return value.lower()
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError:
        return None


class Understood:
    """What the columns say of a record besides its own headers, from its block piece by piece; payloads are digested as they come."""

    def __init__(self, headers: dict[str, str], payloads: bool):
        self.headers, self.out, self.kind, self.n = headers, {}, headers.get("warc-type"), 0
        self.stated = headers.get("warc-payload-digest")
        self.http = headers.get("content-type", "").lower().startswith("application/http")
        #: The HTTP head as far as it came, and what was read behind it.
        self.head, self.kept = b"", [] if payloads else None
        self.hash, self.other = hashlib.sha256(), _algorithm(self.stated)

    def take(self, part: bytes) -> None:
        if self.http:
            self.head += part
            head, blank, part = self.head.partition(b"\r\n\r\n")
            if not blank:
                return
            self.head, self.http = head, False
            self._status(head)
        self.n += len(part)
        self.hash.update(part)
        if self.other:
            self.other.update(part)
        if self.kept is not None:
            self.kept.append(part)

    def _status(self, head: bytes) -> None:
        words = head.split(b" ", 2)
        if head.startswith(b"HTTP/") and len(words) > 1:
            self.out["http_status"] = words[1].decode("utf-8", "replace")
        said = headers_of(head).get("content-length", "")
        if self.kind == "revisit" and said.isascii() and said.isdigit():
            self.out["payload_bytes"] = int(said)

    def row(self) -> dict:
        if self.http:  # a head and nothing behind it
            self._status(self.head)
        if self.kind == "revisit":
            return self.out | {"payload_digest": _sha256(self.stated)}
        if self.kind != "request":
            self.out |= {"payload_bytes": self.n, "payload_digest": self.hash.hexdigest(), "digest_ok": _agrees(self.stated, self.other)}
        return self.out | ({"payload": b"".join(self.kept)} if self.kept is not None else {})


def _understood(file: str, head: bytes, block: list[bytes], payloads: bool) -> dict:
    headers = headers_of(head)
    told = Understood(headers, payloads)
    for part in block:
        told.take(part)
    return {name: headers.get(header) for name, _, header in FIELDS if header} | told.row() | {"file": file}


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows of RECORD, some at a time."""
    held, size = [], 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in held], _ARROW[kind]) for name, kind, _ in FIELDS], [name for name, _, _ in FIELDS])

    for row in rows:
        held.append(row)
        size += len(row.get("payload") or b"")
        if len(held) >= 1000 or size > 4 << 20:
            yield told()
            held, size = [], 0
    if held:
        yield told()


def _alone(payloads: bool):
    """For mapInArrow: pieces (file, piece) that are a record each, or none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for file, piece in zip(batch.column("file"), batch.column("piece")):
                file, piece = file.as_py(), piece.as_py()
                if not piece.strip(b"\r\n"):
                    continue
                found = _parts(piece)
                if not isinstance(found, str) and len(found[1]) >= found[2] and not found[1][found[2] :].strip(b"\r\n"):
                    yield _understood(file, found[0], [found[1][: found[2]]], payloads)
                else:
                    yield {"file": file, "error": found if isinstance(found, str) else "its length is wrong", "payload": piece}

    return lambda batches: _batches(rows(batches))


def _together(payloads: bool):
    """For mapInArrow: pieces of records that span several (file, record, piece), record by record in order; one piece is held at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        of, told, headers, left = None, None, {}, 0

        def done() -> dict:
            return {name: headers.get(header) for name, _, header in FIELDS if header} | told.row() | {"file": of[0]}

        for batch in batches:
            for file, record, piece in zip(batch.column("file"), batch.column("record"), batch.column("piece")):
                here, part = (file.as_py(), record.as_py()), piece.as_py()
                if here != of:
                    if of is not None:
                        yield done()
                    head, part, left = _parts(part)
                    of, headers = here, headers_of(head)
                    told = Understood(headers, payloads)
                else:
                    part = SEPARATOR.encode() + part
                told.take(part[:left])
                left -= min(left, len(part))
        if of is not None:
            yield done()

    return lambda batches: _batches(rows(batches))


def read_archives(spark: SparkSession, path: str, payloads: bool = True, glob: str = "*") -> DataFrame:
    """One row for each record of the WARC files under ``path``; what isn't one has an error, and its bytes as payload.

    Without ``payloads`` they are digested, but not returned.
    """
    raw = F.col("value").cast("binary")
    piece = F.when(F.startswith("value", F.lit("WARC/")), F.substr(raw, F.lit(6))).otherwise(raw)
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", SEPARATOR).text(path)
    # Pieces of one part of a file are numbered in order; both passes read the same parts.
    pieces = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), piece.alias("piece"))
    text = F.col("piece").cast("string")
    head = F.when(text.rlike("^[0-9]") & F.contains(text, F.lit(CRLF + CRLF)), F.substring_index(text, CRLF + CRLF, 1)).cast("binary").alias("head")
    end = F.when(text.endswith("\n") | text.endswith("\r"), F.substring("piece", -ENDS, ENDS)).alias("end")
    # Heads and lengths of a file go through one task in order; they are some hundred bytes a record.
    heads = pieces.select("file", "block", "k", F.octet_length("piece").cast("long").alias("size"), end, head)
    spread = heads.repartition("file").sortWithinPartitions("file", "block", "k").mapInArrow(_chained, "file string, block long, k long, record long")
    spread = cut(spread, "spread")
    each = pieces.join(fitting(spread), ["file", "block", "k"], "left").select("file", "block", "k", "record", "piece")
    alone = each.where("record IS NULL").select("file", "piece").mapInArrow(_alone(payloads), RECORD)
    parts = each.where("record IS NOT NULL").repartition("file", "record").sortWithinPartitions("file", "record", "block", "k")
    return alone.unionByName(parts.select("file", "record", "piece").mapInArrow(_together(payloads), RECORD))


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: the response or revisit with its request and metadata.

    ``found`` is read twice and had better be a table in files. A capture
    without a request or metadata has null there; rows with an error are none.
    """
    main = found.where("type in ('response', 'revisit')").alias("m")
    one = F.struct("record_id", "target", "payload")
    # Requests and metadata meet by the record that they name, in one pass; of several of a kind the smallest id counts.
    beside = found.where("type in ('request', 'metadata') and concurrent_to is not null").groupBy("concurrent_to").agg(*[F.min(F.when(F.col("type") == kind, one)).alias(kind) for kind in ("request", "metadata")])
    joined = main.join(beside.withColumnRenamed("concurrent_to", "of"), F.col("m.record_id") == F.col("of"), "left")
    capture = F.struct(*[F.col(f"m.{c}").alias(c) for c in ("record_id", "type", "target", "page_id", "refers_to", "refers_to_record", "http_status", "payload_bytes", "payload_digest", "digest_ok", "payload")])
    return joined.select(capture.alias("capture"), "request", "metadata")


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder, reads them back once and assembles the transactions."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return assemble(cut(read_archives(spark, path, payloads), "records"))


def report(pages: DataFrame) -> DataFrame:
    """The digest columns of :func:`round_trip`."""
    kind = dict(pages.dtypes)["page_id"]
    return round_trip(pages, payloads=False).select(
        F.col("capture.page_id").cast(kind).alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"), F.col("capture.refers_to").cast(kind).alias("refers_to"), F.col("request.target").alias("request_target"), F.col("metadata.record_id").isNotNull().alias("has_metadata"),
    )
