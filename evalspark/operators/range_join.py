"""Joins of numbers with ranges, given as a table: thousands of bins, bins per keyword, bins that overlap.

A range lies in at most two cells of its level, the smallest power of two that is wider, and a number lies in one cell of
every level. So ranges are listed by level and cell, and numbers are looked up by equality, once per level that occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _level(first: Column, last: Column) -> Column:
    """As many bits as the width has; 63 where it has more or is no long."""
    bits = F.length(F.bin(F.try_subtract(last, first)))
    return F.least(F.coalesce(bits, F.lit(63)), F.lit(63)).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def range_join(
    numbers: DataFrame,
    ranges: DataFrame,
    value: str,
    by: Sequence[str] = (),
    low: str = "low",
    high: str = "high",
) -> DataFrame:
    """Rows of ``numbers`` with each of the ``ranges`` their ``value`` lies in: above ``low`` and up to ``high``, whole numbers.

    A null ``low`` or ``high`` leaves that end open; a null value is in no range, and a range that ends where it
    begins has no number. ``by`` are columns that must be equal in both tables, such as a keyword. The levels that occur, at most
    64, come to the driver; the rest is one equi-join. Numbers are repeated once per level, so ranges of similar width
    cost least; adaptive execution may split a cell with very many numbers.
    """
    above = F.when(F.col(low).isNull(), F.lit(LOWEST)).when(F.col(low) < HIGHEST, F.col(low).cast("long") + 1)
    payload = [c for c in ranges.columns if c not in by]
    bounds = ranges.select(
        *by,
        F.struct(*payload).alias("range"),
        above.alias("first"),
        F.coalesce(F.col(high).cast("long"), F.lit(HIGHEST)).alias("last"),
    ).where("first <= last")
    bounds = bounds.withColumn("level", _level(F.col("first"), F.col("last")))
    levels = sorted(r["level"] for r in bounds.select("level").distinct().collect())
    cells = F.array_distinct(F.array(_cell(F.col("first"), F.col("level")), _cell(F.col("last"), F.col("level"))))
    listed = bounds.withColumn("cell", F.explode(cells))

    x = F.col(value).cast("long")
    known = numbers.where(x.isNotNull())
    if not levels:
        known, levels = known.limit(0), [0]
    places = [F.struct(F.lit(k).alias("level"), _cell(x, F.lit(k)).alias("cell")) for k in levels]
    looked_up = known.select(
        *by, F.struct(*numbers.columns).alias("row"), x.alias("x"), F.inline(F.array(*places))
    )
    met = looked_up.join(listed, [*by, "level", "cell"]).where(F.col("x").between(F.col("first"), F.col("last")))
    return met.select("row.*", *[F.col("range")[c].alias(c) for c in payload])
