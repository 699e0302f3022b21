import re

from tests.llm.conftest import rows_of
from turnlake.llm import common, url_filter
from turnlake.operators import bloom

PAGES = "page_id long, url string, html string"


def expected(rows, rules=url_filter.RULES, listed=url_filter.LISTED):
    out = []
    for i, u in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        best = None
        for late, table in ((False, rules), (True, listed)):
            fits = sorted((-len(h + p), h + p, v) for h, p, v in table if (host == h or host.endswith("." + h)) and path.startswith(p) and host)
            if fits and best is None:
                best = (late, fits[0][1], fits[0][2])
        out.append((i, host, path, None if best is None or best[0] else best[1], best[2] if best else "allow"))
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


def test_matches_brute_force(spark):
    hosts = ["net", "example.net", "www.Example.NET", "xexample.net", "example.com", "m.example.com", "a.b.org", "org", "ads-track.example.com", "x.free-bets.example.net", "nét", ""]
    rows = [(k, f"{s}://{h}{p}") for k, (s, h, p) in enumerate((s, h, p) for s in ("http", "a://b") for h in hosts for p in ("", "/", "/en/1?x=/de/", "/de/", "/fr/#t", "/de", "?q", "#/en/", "/en/\n://"))]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "http://net/" + "a/" * 5000), (904, "http://net/"), (904, "http://net/"), (None, "http://net/")]
    df = url_filter.judge(spark.createDataFrame([(*r, "") for r in rows], PAGES), url_filter.rules_table(spark))
    assert rows_of(df) == expected(rows)


def test_many_listed_urls_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    listed = [(f"h{k}.com", f"/{k % 7}/", "block") for k in range(3000)] + [("h1.com", "/1/1", "allow")]
    rows = [(k, f"http://www.h{k}.com/{k % 5}/1") for k in range(4000)]
    df = url_filter.judge(spark.createDataFrame([(*r, "") for r in rows], PAGES), url_filter.rules_table(spark, url_filter.RULES, listed))
    assert rows_of(df) == expected(rows, listed=listed)


def test_five_million_listed_keys_are_one_broadcast(spark):
    from pyspark.sql import functions as F

    n = 5_000_000
    pages = common.cut(bloom.built(spark.range(n).select(F.xxhash64("id")), n), "pages")
    rows = bloom.possible(spark.range(n - 50_000, n + 50_000), F.xxhash64("id"), pages, n)
    assert pages.count() == bloom.pages_for(n) < 1300
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.where(f"id < {n}").count() == 50_000 and rows.where(f"id >= {n}").count() < 500


def test_the_filter_passes_some_false_positives_but_no_listed_key(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(bloom, "BITS_PER_KEY", 1)
    keys = spark.range(60_000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key_host"), F.lit("/").alias("key_path"))
    urls = spark.range(55_000, 65_000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.lit("/a").alias("path"))
    passed = url_filter.possible(urls, keys, [1], 60_000)
    assert passed.where("substr(host, 2) < 60000").count() == 5000
    assert 0 < passed.where("substr(host, 2) >= 60000").count() < 5000


def test_empty_tables_and_other_columns(spark):
    rules = url_filter.rules_table(spark)
    assert url_filter.judge(spark.createDataFrame([], PAGES), rules).count() == 0
    odd = spark.createDataFrame([(1, "http://a.net/", "x", 2)], "page_id long, url string, host string, verdict int")
    assert rows_of(url_filter.judge(odd, rules)) == [(1, "a.net", "/", "net/", "block")]
    assert url_filter.judge(odd, rules.limit(0)).first()["verdict"] == "allow"
    assert url_filter.rules_table(spark, [], []).count() == 0
    assert rows_of(url_filter.rules_table(spark, [("a'b", "/\\x", "allow")], [])) == [("a'b", "/\\x", "allow", True)]
