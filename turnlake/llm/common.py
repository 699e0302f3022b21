"""Pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.sources.scratch import cut, new_path  # noqa: F401  (operators take them from here)

#: White space of the contracts, as the body of a character class.
SPACE = r"\x20\x09-\x0D"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else the table has.

    Columns are taken by position, so extra columns that differ only in case
    or repeat a name do not make the reference ambiguous; of equal names the
    first counts.
    """
    at = {name: k for k, name in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"__{k}" for k in range(len(df.columns))])
    return plain.select(*[F.col(f"__{at[name]}").alias(name) for name in names])


def carried(df: DataFrame, carry: Sequence[str], *names: str) -> DataFrame:
    """The named columns, and those of ``carry`` that aren't among them under names that clash with nothing."""
    at = {name: k for k, name in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"__{k}" for k in range(len(df.columns))])
    rest = [F.col(f"__{at[c]}").alias(f"__c{j}") for j, c in enumerate(carry) if c not in names]
    return plain.select(*[F.col(f"__{at[name]}").alias(name) for name in names], *rest)


def restored(carry: Sequence[str], *names: str) -> list[Column]:
    """The columns of ``carry`` under their own names again."""
    return [F.col(c) if c in names else F.col(f"__c{j}").alias(c) for j, c in enumerate(carry)]


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Characters beyond ASCII that ``lower`` may change: capitals of any kind, and code points that the pattern's Unicode tables don't know yet.
_OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^\x00-\x7F]]"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` is much the faster function but also changes other scripts, so
    only texts with capitals beyond ASCII take the character map.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(~ascii_only & text.rlike(_OTHER_CAPITALS), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def word_count(text: Column) -> Column:
    """Number of maximal runs without the contracts' white space, as long."""
    return F.size(pieces(text, f"[{SPACE}]+")).cast("long")


def pieces(text: Column, between: str) -> Column:
    """What lies between the matches of a pattern, without empty strings.

    Splitting a text takes time in proportion to its length; extracting all
    matches copies the whole text for each of them.
    """
    return F.array_remove(F.split(text, between, -1), "")


#: Bytes of rows up to which :func:`fitting` sends a copy to every executor, and what a row takes besides its texts.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 64


def fitting(df: DataFrame) -> DataFrame:
    """``df``, a table in files, marked for a broadcast if its rows are measured to fit, else for a join that shuffles both sides."""
    size = F.lit(0).cast("long")
    for field in df.schema:
        kind, c = field.dataType.simpleString(), F.col(field.name)
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array<string>":
            size += F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0))
    whole = df.agg(F.coalesce(F.sum(size + ROW_BYTES), F.lit(0))).first()[0]
    return F.broadcast(df) if whole <= BROADCAST_BYTES else df.hint("merge")
