"""Counts of rows, or of the rows that a pre-aggregated table stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_rows(weight: str | None = None) -> Column:
    """Number of rows; with ``weight``, the sum of that column, which says how many each row stands for."""
    return F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))


def count_where(condition: Column, weight: str | None = None) -> Column:
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))
