"""A blocked Bloom filter as a small table that every executor gets.

Keys are told by a 64-bit hash. It chooses a page, a block of 64 bits in the
page and four bits of the block. Pages are rows of 1,024 blocks each, so the
filter takes two bytes a key and no more rows than it has pages, and testing a
row is one look-up in a broadcast join. Beyond MOST_PAGES the filter doesn't
grow but lets more keys pass: its size is bounded whatever the number of keys,
and what it lets through has to be compared exactly anyhow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
#: Blocks of 64 bits in a page, and pages at most: 64 MB.
BLOCKS, MOST_PAGES = 1024, 8192


def pages_for(n_keys: int) -> int:
    return max(1, min(MOST_PAGES, -(-n_keys * BITS_PER_KEY // (BLOCKS * 64))))


def _page(h: Column, n_pages: int) -> Column:
    return F.pmod(h, F.lit(n_pages)).cast("int")


def _block(h: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(h), 24).bitwiseAND(F.lit(BLOCKS - 1)).cast("int")


def _mask(h: Column) -> Column:
    mixed, out = F.xxhash64(h), None
    for k in (0, 6, 12, 18):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(mixed, k).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def built(hashes: DataFrame, n_keys: int) -> DataFrame:
    """(page, bits) of the keys whose hashes are the only column of ``hashes``."""
    h, n_pages = F.col(hashes.columns[0]), pages_for(n_keys)
    marked = hashes.select(_page(h, n_pages).alias("page"), _block(h).alias("block"), _mask(h).alias("mask"))
    # Blocks without a key are zero, so that a page is an array by block.
    k = F.col("id")
    blank = hashes.sparkSession.range(n_pages * BLOCKS).select(F.floor(k / BLOCKS).cast("int").alias("page"), (k % BLOCKS).cast("int").alias("block"), F.lit(0).cast("long").alias("mask"))
    whole = marked.unionByName(blank).groupBy("page", "block").agg(F.bit_or("mask").alias("mask"))
    return whole.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("block", "mask")))["mask"].alias("bits"))


def _joined(h: Column, n_keys: int) -> Column:
    return (_page(h, pages_for(n_keys)) == F.col("__page")) & (F.get("__bits", _block(h)).bitwiseAND(_mask(h)) == _mask(h))


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys.select(F.col("page").alias("__page"), F.col("bits").alias("__bits")))


def possible(rows: DataFrame, h: Column, keys: DataFrame, n_keys: int) -> DataFrame:
    """The rows whose hash ``h`` may be one of the filter ``keys`` (of :func:`built`, for the same ``n_keys``)."""
    return rows.join(_sent(keys), _joined(h, n_keys), "left_semi")


def flagged(rows: DataFrame, h: Column, keys: DataFrame, n_keys: int, name: str) -> DataFrame:
    """All rows, with a column that tells whether their hash may be one of the filter; false for null."""
    return rows.join(_sent(keys), _joined(h, n_keys), "left").withColumn(name, F.col("__page").isNotNull()).drop("__page", "__bits")
