"""Filters of fixed size: a bit for each key, so that rows which surely have none of the keys need no shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 24


def numbered(rows: DataFrame) -> DataFrame:
    """The table with ``row``, a number for each row that stays the same as long as the stored table does."""
    return rows.withColumn("row", F.monotonically_increasing_id())


def packed(documents: DataFrame) -> DataFrame:
    """Numbered rows whose own columns are one struct, ``own``, so that no name can clash."""
    return numbered(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own")))


def unpacked(columns: list[str], **new: Column) -> list[Column]:
    """The columns of ``own``, some of them replaced; others that are new follow and take the place of such names."""
    old = [new[c] if c in new else F.col(f"own.`{c}`") for c in columns]
    return [x.alias(c) for x, c in zip(old, columns)] + [x.alias(c) for c, x in new.items() if c not in columns]


def bits(keys: DataFrame, key: Column) -> DataFrame:
    """A bit for each hash of ``key`` in a table of fixed size: ``at`` and ``bits``, at most FILTER_BITS / 64 rows."""
    hashed = keys.select(F.pmod(key, F.lit(FILTER_BITS)).alias("h"))
    return hashed.groupBy(F.expr("cast(h div 64 AS int)").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h % 64 AS int))")).alias("bits")
    )


def marked(rows: DataFrame, key: Column, set_bits: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``, whether the bit of ``key`` is set; false says surely not."""
    h = F.pmod(key, F.lit(FILTER_BITS))
    keyed = rows.withColumns({"at": F.floor(h / 64).cast("int"), "bit": F.pmod(h, F.lit(64)).cast("int")})
    joined = keyed.join(F.broadcast(set_bits), "at", "left")
    maybe = F.coalesce(F.expr("(shiftrightunsigned(bits, bit) & 1) = 1"), F.lit(False))
    return joined.withColumn("maybe", maybe).drop("at", "bit", "bits")


def table_of(set_bits: DataFrame) -> np.ndarray:
    """The bits as 64-bit words, on the driver; their size does not depend on the input."""
    got = set_bits.toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered ``rows`` without those whose ``row`` is in ``gone`` (a stored table)."""
    rows = marked(rows, F.xxhash64("row"), bits(gone, F.xxhash64("row")))
    left = rows.where("maybe").join(gone.select("row"), "row", "left_anti")
    return left.unionByName(rows.where("NOT maybe")).drop("maybe")
