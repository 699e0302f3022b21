"""URL filter: a blocked Bloom filter in front of an exact hash join.

Every url is reduced to the canonical keys under which a list could name it:
its host and each domain above it, with each prefix of its path that is as long
as some listed path. A blocked Bloom filter of the listed keys, packed in pages
that every executor has, tests them where the url is read: first the domain
alone, and only for possible ones the prefixes of the path. What passes, and
nothing else, is shuffled to an exact join on the key, which removes what the
filter passed by mistake.

Only built-in functions run. The filter's size is bounded (see ``bloom``);
listed keys are broadcast only if they are measured to fit, else both sides of
the exact join are shuffled, and the list is a table in files, so that Spark
can split a key that many urls have.

Defined results: a null url, or one without ``://``, has an empty host and
path and fits nothing; an empty path fits only an empty listed path; repeated
rows each get their verdict; an empty list allows everything; other columns of
the table are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import cut, fitting, pick
from turnlake.operators import bloom

#: (host, path, verdict): the rules that win over the list of urls.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: (host, path, verdict): urls that the filter lists besides, for which no rule is reported: advertising, gambling and spam domains.
LISTED = tuple((f"{name}.example.{top}", "/", "block") for name in ("ads-track", "casino-win", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _texts(*fields: str) -> str:
    return "(" + ", ".join("'" + f.replace("\\", "\\\\").replace("'", "\\'") + "'" for f in fields)


def rules_table(spark: SparkSession, rules: Sequence[tuple] = RULES, listed: Sequence[tuple] = LISTED) -> DataFrame:
    """The listing that :func:`judge` takes: host, path, verdict, is_rule."""
    rows = [_texts(*r) + ", true)" for r in rules] + [_texts(*r) + ", false)" for r in listed]
    none = "WHERE false" if not rows else ""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows or [_texts('', '', '') + ', true)'])} AS t(host, path, verdict, is_rule) {none}")


def _domain(host: Column) -> Column:
    """The hash of a listed host by itself."""
    return F.xxhash64(host)


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def possible(urls: DataFrame, keys: DataFrame, lengths: Sequence[int], n_keys: int) -> DataFrame:
    """host, path, key_host and key_path of the distinct (host, path) in ``urls`` that the filter of ``keys`` (key_host, key_path) passes."""
    n = 2 * n_keys
    pages = bloom.built(keys.select(F.explode(F.array(_domain(F.col("key_host")), _key(F.col("key_host"), F.col("key_path")))).alias("h")), n)
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.lit(list(lengths)).cast("array<int>"), lambda k: k <= F.length("path")), lambda k: F.col("path").substr(F.lit(1), k))
    hosts = urls.where("host <> ''").select("host", "path", F.explode(domains).alias("key_host"))
    near = bloom.possible(hosts, _domain(F.col("key_host")), pages, n)
    return bloom.possible(near.withColumn("key_path", F.explode(prefixes)), _key(F.col("key_host"), F.col("key_path")), pages, n).distinct()


def judge(pages: DataFrame, listing: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Host, path, the rule that fits and the verdict, for every row of ``pages``.

    ``listing`` has host, path, verdict (allow or block) and is_rule; null
    hosts and paths count as empty. A listed key fits its host and all
    subdomains if the url's path starts with its path. The longest fitting rule
    wins (host and path; then the smaller text), then the longest fitting
    listed url; without either the verdict is allow.
    """
    keys = pick(listing, "host", "path", "verdict", "is_rule").select(
        F.coalesce("host", F.lit("")).alias("key_host"), F.coalesce("path", F.lit("")).alias("key_path"), "verdict", F.coalesce("is_rule", F.lit(False)).alias("is_rule")
    )
    keys = cut(keys, "listed")
    # Lengths of listed paths: as many numbers as there are different lengths of a url, never as many as there are urls.
    n_keys, lengths = keys.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.length("key_path")))).first()
    urls = pick(pages, *keep, url).select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hits = possible(urls.select("host", "path"), keys, lengths, n_keys).join(fitting(keys), ["key_host", "key_path"])
    name = F.concat("key_host", "key_path")
    best = F.min(F.struct((~F.col("is_rule")).alias("late"), (-F.length(name)).alias("short"), name.alias("name"), F.col("verdict").alias("verdict")))
    # Written, so that the join below deals both sides out anew and Spark can split a frequent url among tasks;
    # it grows with the pages, so it isn't broadcast.
    won = cut(hits.groupBy("host", "path").agg(best.alias("best")).select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), F.col("best.late").alias("late"), F.col("best.name").alias("name"), F.col("best.verdict").alias("found")), "won")
    return urls.join(won.hint("merge"), (urls.host == won.of_host) & (urls.path == won.of_path), "left").select(
        *keep, "host", "path", F.when(~F.col("late"), F.col("name")).alias("rule"), F.coalesce("found", F.lit("allow")).alias("verdict")
    )
