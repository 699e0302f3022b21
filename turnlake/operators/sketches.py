"""Roll-ups of sketches: distinct counts and quantiles that can be merged over any days and projects.

A distinct count over a range of days is not the sum of the days' counts, nor a
median that of medians, so exact ones read all rows of the range. A roll-up
keeps an HLL sketch for each thing to count and a KLL sketch for each number, by
day and whatever else is filtered or grouped by; a query merges the sketches of
the rows that it wants, some kilobytes each, and never reads the rows behind
them. Days are independent, so new lines mean new sketches for their days only.

Errors: an HLL sketch of 2 ** ``BITS`` registers is off by 1.04 / sqrt(2 **
BITS), about 1.6 %, in one of three cases, and counts up to some hundreds almost
exactly; a KLL sketch of size ``SIZE`` gives a value whose rank is within about
``RANK`` of the one that was asked for, in 99 of 100 cases.

Defined results: nulls are not counted; a group without values has the count 0
and null for quantiles.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of an HLL sketch (a power of two), items of a KLL sketch, and its rank error.
BITS, SIZE, RANK = 12, 400, 0.01


def rollup(rows: DataFrame, by: list[str], distinct: Mapping[str, Column], numbers: Mapping[str, Column], sums: Mapping[str, Column]) -> DataFrame:
    """One row for each group: sums, and sketches named ``<name>_hll`` and ``<name>_kll``; numbers are whole."""
    return rows.groupBy(*by).agg(
        *[F.sum(c).cast("long").alias(name) for name, c in sums.items()],
        *[F.hll_sketch_agg(c, BITS).alias(f"{name}_hll") for name, c in distinct.items()],
        *[F.kll_sketch_agg_bigint(c.cast("long"), F.lit(SIZE)).alias(f"{name}_kll") for name, c in numbers.items()],
    )


def merged(sketches: DataFrame, by: list[str], quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """Sketches of :func:`rollup` merged ``by`` columns: sums again, distinct counts under their names, and ``<name>_<quantile's name>`` for each number."""
    names = sketches.columns
    hll, kll = ([c for c in names if c.endswith(end)] for end in ("_hll", "_kll"))
    sums = [c for c, kind in sketches.dtypes if kind == "bigint" and c not in by]
    whole = sketches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], *[F.hll_union_agg(c).alias(c) for c in hll], *[F.kll_merge_agg_bigint(c).alias(c) for c in kll])
    told = [F.hll_sketch_estimate(c).alias(c.removesuffix("_hll")) for c in hll]
    some = lambda c: F.kll_sketch_get_n_bigint(c) > 0
    told += [F.when(some(c), F.kll_sketch_get_quantile_bigint(c, F.lit(q))).alias(f"{c.removesuffix('_kll')}_{name}") for c in kll for name, q in (quantiles or {}).items()]
    return whole.select(*by, *sums, *told)


def hll_close(estimate: Column, exact: Column, sigmas: float = 4.0) -> Column:
    """An estimate is within its bound of the exact count."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * (sigmas * 1.04 / 2 ** (BITS / 2)))
