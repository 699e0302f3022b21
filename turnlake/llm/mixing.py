"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources, ordered by code point (null last), weigh 1, 2, 3, repeating, and share
the words of the corpus. A target stops at three times its source's size; the
excess goes to the others by weight until none is above.

The mix is dealt out in blocks of as many words each. Blocks go to sources by
the highest quotients target / (2 k + 1), as seats go to parties, and within a
source to its shards by the quotients of their sizes, which gives every shard
an integer quota. A shard is a seeded order of some of its source's documents,
read as one line of words and cut into equal blocks; of these a seeded choice
fills the quota, going round again, up to three times, where the quota is
larger than the shard. A document's share is what the chosen blocks have of it.

Rather than list the quotients of all blocks, each party starts with the seats
that it is sure to win and only the few quotients around the last seat are
ranked, so a step handles some rows for each source or shard whatever the
number of blocks. Shards hold a bounded number of words, so a source with a
third of all rows is many shards; sources deal their seats to bundles of a
thousand shards and those to their shards, so no task ranks more than that.
Which blocks of a shard are chosen is a seeded permutation of their numbers, so
every document tells for itself and blocks are listed nowhere.

Defined results: null texts have no words, are in no block and take 0; a null
source is one source; rows that repeat a doc_id are documents of their own, and
equal rows get equal shares; null doc_ids are told apart by their texts; with no
words at all targets are 0; an empty table gives an empty result; other columns
are left alone, but those named as a column of the result, in whatever case,
give way to it. All choices depend on the seed and the rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import carried, cut, restored, text_of, word_count

WEIGHTS = (1, 2, 3)
#: A source's target, and what is taken of a document, in sizes at most.
MOST = 3
#: Words in a block, and in a shard, about.
BLOCK_WORDS, SHARD_WORDS = 128, 1_000_000
#: Shards in a bundle, at most.
BUNDLE = 1000
SEED = 17
#: Columns of the result.
MADE = ("size", "source_size", "target", "taken")
#: The largest primes below 2 ** 31: being above any number of blocks of a shard, they have no divisor in common with it.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def _seeded(seed: int, *cols: str | Column) -> Column:
    """A text that orders rows as if by chance, the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).cast("binary"))


def _number(seeded: Column, at: int) -> Column:
    """Eight hex digits of a seeded text as a number."""
    return F.conv(F.substring(seeded, at, 8), 16, 10).cast("long")


def turned(block: Column, n_blocks: Column, seeded: Column) -> Column:
    """The place of a block in a permutation of the numbers below ``n_blocks``."""
    prime = F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), (_number(seeded, 1) % len(PRIMES) + 1).cast("int"))
    return F.pmod(prime * block + _number(seeded, 9), n_blocks)


def targets(sizes: DataFrame) -> DataFrame:
    """source (a number from 1, in order), its name, source_size, target.

    ``sizes`` has source and size, one row for each source at least; the
    windows here see one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy()
    order = everyone.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = per.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight).withColumn("most", (MOST * F.col("source_size")).cast("double"))
    # In order of most / weight the capped sources come first: a source is capped if, with all before it capped, its share is above its cap.
    by_level = everyone.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everyone).cast("double")).withColumn("all_weight", F.sum("weight").over(everyone))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), zero)) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), zero)))
    )
    rows = rows.withColumn("capped", F.col("level") * F.col("weight") > F.col("most"))
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("most") / F.col("weight")).alias("at"), "rank", "level"))).over(everyone)["level"]
    return rows.select("rank", F.col("source").alias("name"), "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.coalesce(level, zero) * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, within: Sequence[str], party: str, votes: str, seats: str, most: str) -> DataFrame:
    """``parties`` with a column quota: Sainte-Lague seats, at most ``most`` for each party.

    The column ``seats`` has the seats that each group of the columns
    ``within`` deals out. Equal quotients go to the smaller party. If the limits
    leave fewer seats than that, all of them are filled.
    """
    group = Window.partitionBy(*within)
    all_votes, n = F.sum(votes).over(group), F.count(F.lit(1)).over(group)
    rows = parties.withColumn("even", F.when(all_votes > 0, F.col(votes) * F.col(seats) / all_votes).otherwise(F.lit(0.0))).withColumn("slack", F.when(F.col(seats) > 0, n / (2.0 * F.col(seats))).otherwise(F.lit(0.0)))
    # Seats differ from an even share by rounding at a divisor that rounding has moved by this slack at most.
    sure = F.greatest(F.ceil(F.col("even") * (1 - F.col("slack")) - 1), F.lit(0)).cast("long")
    rows = rows.withColumn("sure", F.least(sure, F.col(most)))
    return rows.withColumn("rest", F.col(seats) - F.sum("sure").over(group)).transform(lambda df: _last_seats(df, within, party, votes, most))


def _last_seats(rows: DataFrame, within: Sequence[str], party: str, votes: str, most: str) -> DataFrame:
    """Fills the seats ``rest`` by the highest quotients above the sure seats."""
    keys = [*within, party]
    # Each party may need its slack again, and more where limits pass seats on.
    need = F.least(F.greatest(F.col("rest"), F.lit(0)), F.col(most) - F.col("sure"), F.ceil(2 * F.col("even") * F.col("slack")).cast("long") + 3 + F.col("passed"))
    limited = F.sum(F.greatest(F.col("even") - F.col(most), F.lit(0.0))).over(Window.partitionBy(*within))
    rows = rows.withColumn("passed", F.ceil(limited).cast("long")).withColumn("need", F.greatest(need, F.lit(0).cast("long")))
    offers = rows.where("need > 0").select(*keys, "rest", F.col(votes).alias("votes"), F.explode(F.sequence(F.col("sure"), F.col("sure") + F.col("need") - 1)).alias("k"))
    best = Window.partitionBy(*within).orderBy((F.col("votes") / (2 * F.col("k") + 1)).desc(), party, "k")
    won = offers.withColumn("place", F.row_number().over(best)).where("place <= rest").groupBy(*keys).agg(F.count(F.lit(1)).alias("won"))
    return rows.join(won, keys, "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0))).drop("even", "slack", "sure", "rest", "passed", "need", "won")


def mix(docs: DataFrame, carry: Sequence[str] = (), block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, bundle: int = BUNDLE) -> DataFrame:
    """For each row of ``docs``: the columns ``carry`` (or doc_id), size, source_size, target and taken."""
    carry = [c for c in carry if c.lower() not in MADE]
    read = carried(docs, carry, "doc_id", "text", "source")
    version = F.xxhash64(text_of()).alias("version")
    # The texts are read here, and again only if they are to be carried.
    light = cut(read.select("doc_id", F.col("source").alias("name"), word_count(text_of()).alias("size"), version), "sizes")
    per_source = cut(targets(light.select(F.col("name").alias("source"), "size")), "targets")

    n_shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")
    of_name = per_source.select("rank", F.col("name").alias("of"), "source_size", "target", n_shards.alias("n_shards"))
    # One row for each source: the catalogue of sources, which is far below the size of any row group; Spark checks it before it broadcasts.
    told = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.col("version").cast("string")))
    placed = (
        light.where("size > 0").groupBy("doc_id", "name", "size", "version").agg(F.count(F.lit(1)).alias("copies"))
        .join(of_name, F.col("name").eqNullSafe(F.col("of"))).withColumn("told", told)
        .withColumn("shard", F.pmod(_number(_seeded(seed, "told"), 1), F.col("n_shards")))
        .select("doc_id", "told", "version", "size", "copies", "rank", "shard")
    )
    # Equal rows lie side by side as one run.
    line = Window.partitionBy("rank", "shard").orderBy(_seeded(seed + 1, "told"), "doc_id", "version").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(placed.withColumn("end", F.sum(F.col("size") * F.col("copies")).over(line)).drop("told"), "shards")

    blocks = F.greatest(F.round(F.col("shard_size") / block_words), F.lit(1)).cast("long")
    shards = placed.groupBy("rank", "shard").agg(F.max("end").alias("shard_size")).withColumn("n_blocks", blocks).withColumn("most", MOST * F.col("n_blocks")).withColumn("bundle", F.floor(F.col("shard") / bundle))
    summed = lambda rows, *by: rows.groupBy(*by).agg(F.sum("shard_size").alias("words"), F.sum("most").alias("most"))
    bundles = summed(shards, "rank", "bundle")
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    votes = per_source.join(bundles.groupBy("rank").agg(F.sum("most").alias("most")), "rank").withColumn("seats", seats).withColumn("all", F.lit(1))
    of_sources = apportion(votes, ["all"], "rank", "target", "seats", "most").select("rank", F.col("quota").alias("seats"))
    of_bundles = apportion(bundles.join(of_sources, "rank"), ["rank"], "bundle", "words", "seats", "most").select("rank", "bundle", F.col("quota").alias("seats"))
    shards = apportion(shards.join(of_bundles, ["rank", "bundle"]), ["rank", "bundle"], "shard", "shard_size", "seats", "most")
    shards = cut(shards.select("rank", "shard", "shard_size", "n_blocks", "quota", _seeded(seed + 2, "rank", "shard").alias("seeded")), "quotas")

    # Every block of a shard is taken as often as the quota goes round; the rest falls to those that the permutation puts first.
    n, block = F.col("n_blocks"), F.col("block")
    times = F.floor(F.col("quota") / n) + F.when(turned(block, n, F.col("seeded")) < F.pmod("quota", "n_blocks"), 1).otherwise(0)
    cuts = lambda k: F.floor(k * F.col("shard_size") / n)
    # Blocks that a document may touch; cuts are rounded, so one to either side is asked too.
    begin = F.col("end") - F.col("size") * F.col("copies")
    touch = lambda x: F.floor(x * n / F.col("shard_size"))
    asked = placed.join(shards, ["rank", "shard"]).withColumn("block", F.explode(F.sequence(F.greatest(touch(begin) - 1, F.lit(0)), F.least(touch(F.col("end")) + 1, n - 1))))
    overlap = F.least("end", cuts(block + 1)) - F.greatest(begin, cuts(block))
    got = asked.select("doc_id", "version", "rank", "copies", (times * F.greatest(overlap, F.lit(0))).alias("got"))
    share = got.groupBy(F.col("doc_id").alias("of_doc"), F.col("version").alias("of_version"), F.col("rank").alias("of_rank")).agg(F.floor(F.sum("got") / F.max("copies")).alias("share"))

    rows = read.select("*", F.col("source").alias("name"), word_count(text_of()).alias("size"), version) if carry else light
    sized = rows.join(of_name, F.col("name").eqNullSafe(F.col("of")), "left")
    joined = sized.join(share, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version")) & (F.col("rank") == F.col("of_rank")), "left")
    own = restored(carry, "doc_id", "text", "source") if carry else ["doc_id"]
    return joined.select(*own, "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), "target", F.coalesce("share", F.lit(0)).cast("long").alias("taken"))


def chosen(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which the mix takes something, with their columns and those of :func:`mix`."""
    return mix(docs, docs.columns).where(F.col("taken") > 0)


def report(docs: DataFrame) -> DataFrame:
    return mix(docs)
