import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from turnlake.llm import warc

PAGES = "page_id long, url string, html string"


def expected(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same) if same and len(data) >= 100 else None
        revisit = first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
TRAP = "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 5 + "é😀" * 40


def test_round_trip(spark):
    rows = [(5, "http://a/x", TRAP), (3, "http://b/", TRAP), (9, None, TRAP), (1, "u", None), (2, "u", ""), (4, "u\r\nX: y", "x" * 99), (6, "u", "x" * 99), (7, "u", "x" * 100), (8, "u", "x" * 100), (None, "u", "x" * 100), (10, "u", "\r\n\r\n" * 30), (11, "u", "long " * 50000)]
    got = warc.report(spark.createDataFrame(rows, PAGES))
    assert rows_of(got.select(*COLUMNS)) == expected(rows)
    assert {r["has_metadata"] for r in got.collect()} == {True}


def test_nested_rows_hold_payload_request_and_metadata(spark):
    df = warc.round_trip(spark.createDataFrame([(1, "http://h/p", "<p>hé</p>")], PAGES))
    r = df.first()
    assert bytes(r["capture"]["payload"]).decode() == "<p>hé</p>" and r["capture"]["http_status"] == "200"
    assert bytes(r["request"]["payload"] or b"") == b"" and r["request"]["target"] == "http://h/p"
    assert b"payload-bytes: 10" in bytes(r["metadata"]["payload"])


def test_small_files_repeats_and_a_capture_without_request(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 200), (1, "u", "a" * 200), (2, "u", "a" * 200)], PAGES).coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), records_per_file=2)
    assert len(list((tmp_path / "w").glob("part-*"))) == 5
    found = warc.read_archives(spark, str(tmp_path / "w"))
    assert found.groupBy("type").count().orderBy("type").collect() == [("metadata", 3), ("request", 3), ("response", 2), ("revisit", 1)]
    lone = warc.assemble(found.where("type <> 'request'"))
    assert lone.count() == 3 and lone.where(F.col("request").isNotNull()).count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", chr(97 + k) * 5000) for k in range(12)], PAGES).coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=10_000)
    assert len(list((tmp_path / "w").glob("part-*"))) == 6  # two captures each


def test_revisits_name_their_response(spark):
    got = warc.round_trip(spark.createDataFrame([(2, "http://b/", "x" * 200), (1, "http://a/", "x" * 200)], PAGES)).select("capture.*").collect()
    first, again = sorted(got, key=lambda r: r["type"])
    assert (first["type"], again["type"], again["refers_to"]) == ("response", "revisit", "1") and again["refers_to_record"] == first["record_id"]


def record(kind, block, content_type="application/http;msgtype=response", **headers):
    block = block if isinstance(block, bytes) else block.encode()
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in ({"WARC_Type": kind, "WARC_Record_ID": f"<urn:{kind}-{len(block)}>", "Content_Type": content_type} | headers).items())
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def sha1(data, encode=lambda d: base64.b32encode(d).decode()):
    return "sha1:" + encode(hashlib.sha1(data).digest())


def foreign():
    """Records of other writers: name, bytes."""
    body = b"caf\xe9 \xff body"
    http = b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\n" + body
    trap = b"HTTP/1.0 200\r\n\r\n" + b"a\r\n\r\nWARC/1.0\r\nContent-Length: 1\r\n\r\nz\r\n\r\n" * 3
    return {
        "info": record("warcinfo", "software: x\r\n", "application/warc-fields", WARC_Filename="f"),
        "sha1": record("response", http, WARC_Payload_Digest=sha1(body), WARC_Record_ID="<urn:a>"),
        "hex": record("response", http, WARC_Payload_Digest=sha1(body, bytes.hex).upper().replace("SHA1", "SHA-1"), WARC_Record_ID="<urn:b>"),
        "wrong": record("response", http, WARC_Payload_Digest=sha1(b"other"), WARC_Record_ID="<urn:c>"),
        "unknown": record("response", http, WARC_Payload_Digest="blake9:abc", WARC_Record_ID="<urn:d>"),
        "dns": record("response", "20240101\r\nexample.org. 300 IN A 1.2.3.4", "text/dns", WARC_Target_URI="dns:example.org"),
        "revisit": record("revisit", "HTTP/1.1 304 Not Modified\r\nServer: s\r\n\r\n", WARC_Refers_To="<urn:a>", WARC_Payload_Digest=sha1(body)),
        "bare": record("revisit", "", WARC_Refers_To="<urn:a>"),
        "trap": record("response", trap, WARC_Record_ID="<urn:t>"),
        "folded": record("metadata", "k: v\r\n", "application/warc-fields", WARC_Concurrent_To="<urn:a>", X_Note="one\r\n two"),
    }


def read(spark, folder, **how):
    return {r["record_id"] or r["error"]: r for r in warc.read_archives(spark, str(folder), **how).collect()}


@pytest.mark.parametrize("how", ["plain", "whole.gz", "members.gz"])
def test_archives_of_others(spark, tmp_path, how):
    parts = foreign()
    data = b"".join(parts.values())
    zipped = {"plain": data, "whole.gz": gzip.compress(data), "members.gz": b"".join(map(gzip.compress, parts.values()))}[how]
    (tmp_path / f"crawl.warc{'' if how == 'plain' else '.gz'}").write_bytes(zipped)
    got = read(spark, tmp_path)
    assert len(got) == len(parts) and not [r for r in got.values() if r["error"]]
    body = b"caf\xe9 \xff body"
    for k, ok in (("<urn:a>", True), ("<urn:b>", True), ("<urn:c>", False), ("<urn:d>", None)):
        assert (got[k]["digest_ok"], bytes(got[k]["payload"]), got[k]["http_status"], got[k]["payload_digest"]) == (ok, body, "404", hashlib.sha256(body).hexdigest())
    dns = next(r for r in got.values() if r["target"] == "dns:example.org")
    assert dns["http_status"] is None and dns["payload_bytes"] == len("20240101\r\nexample.org. 300 IN A 1.2.3.4") and bytes(dns["payload"]).startswith(b"20240101")
    revisit, bare = (next(r for r in got.values() if r["type"] == "revisit" and r["http_status"] == s) for s in ("304", None))
    assert (revisit["refers_to_record"], revisit["payload_bytes"], revisit["payload_digest"], revisit["stated_digest"]) == ("<urn:a>", None, None, sha1(body))
    assert bare["refers_to_record"] == "<urn:a>" and bare["payload_bytes"] is None
    assert bytes(got["<urn:t>"]["payload"]).count(b"WARC/1.0") == 3
    rows = warc.assemble(warc.read_archives(spark, str(tmp_path)))
    assert rows.count() == 8 and bytes(rows.where("capture.record_id = '<urn:a>'").first()["metadata"]["payload"]) == b"k: v\r\n"


def test_a_bad_record_is_told_and_the_others_are_read(spark, tmp_path):
    parts = foreign()
    short, long = parts["sha1"].replace(b"Content-Length: ", b"Content-Length: 1"), parts["hex"].replace(b"Content-Length: ", b"Content-Length: 0 * ")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(parts["info"] + short + parts["unknown"] + long + b"WARC/junk\r\n\r\n" + parts["trap"]))
    (tmp_path / "b.warc").write_bytes(parts["wrong"][:-30])
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r["error"] for r in rows if r["error"]) == ["its length is wrong", "its length is wrong", "no content length", "no head"]
    assert {r["record_id"] for r in rows if not r["error"]} == {"<urn:warcinfo-13>", "<urn:d>", "<urn:t>"}
    assert all(r["payload"] and r["file"] for r in rows if r["error"])
    assert warc.assemble(warc.read_archives(spark, str(tmp_path), glob="*.warc.gz")).count() == 2


def test_plain_files_are_read_by_several_tasks(spark, tmp_path):
    one = [record("response", b"HTTP/1.0 200 OK\r\n\r\n" + bytes([97 + k % 26]) * 3000, WARC_Record_ID=f"<urn:{k}>") for k in range(400)]
    (tmp_path / "big.warc").write_bytes(b"".join(one))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        found = warc.read_archives(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 5 and found.where("error is null and payload_bytes = 3000").select("record_id").distinct().count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split", ["20000", "65536", "1000000", "100000000"])
def test_separators_in_payloads_of_plain_files_at_any_split(spark, tmp_path, split):
    """Records of 90 KB that hold the separator a hundred times, others between them, bad ones too."""
    trap = b"x" * 800 + b"\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nhello"
    one = [record("response", b"HTTP/1.0 200 OK\r\n\r\n" + b"%d" % k + trap * 100 + b"\r\n" * (k % 3), WARC_Record_ID=f"<urn:{k}>") for k in range(20)]
    plain = [record("response", b"HTTP/1.0 200 OK\r\n\r\n" + b"y" * 500, WARC_Record_ID=f"<urn:p{k}>") for k in range(20)]
    bad = record("response", b"HTTP/1.0 200 OK\r\n\r\nz", WARC_Record_ID="<urn:bad>").replace(b"Content-Length: ", b"Content-Length: 99999999999999")
    (tmp_path / "a.warc").write_bytes(b"".join(a + b for a, b in zip(one[:10], plain)) + bad + b"".join(one[10:]))
    (tmp_path / "b.warc").write_bytes(b"".join(one[:5]) + b"\r\n" * 9)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        for payloads in (True, False):
            rows = warc.read_archives(spark, str(tmp_path), payloads=payloads).collect()
            assert [r["error"] for r in rows if r["error"]] == ["its length is wrong"]
            got = sorted((r["record_id"], r["payload_bytes"], r["payload_digest"]) for r in rows if not r["error"])
            body = lambda k: b"%d" % k + trap * 100 + b"\r\n" * (k % 3)
            want = [(f"<urn:{k}>", len(body(k)), hashlib.sha256(body(k)).hexdigest()) for k in [*range(20), *range(5)]] + [(f"<urn:p{k}>", 500, hashlib.sha256(b"y" * 500).hexdigest()) for k in range(10)]
            assert got == sorted(want)
            assert not payloads or all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in rows if not r["error"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_table_and_other_columns(spark):
    assert warc.report(spark.createDataFrame([], PAGES)).count() == 0
    odd = spark.createDataFrame([(1, "u", "h", "d", 1)], PAGES + ", digest string, row int")
    assert warc.report(odd).first()["payload_bytes"] == 1
