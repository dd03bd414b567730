"""Length bins, closed on the right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges of the published length analysis.
LENGTH_EDGES = (0, 80, 120, 160, 200, 240, 280, 320, 400, 600, 1000)


def bin_labels(edges: tuple[int, ...]) -> list[str]:
    """``0-80, 81-120, ..., 601+``: the last label is open although the last bin has an upper edge."""
    inner = [f"{lo + 1 if i else lo}-{hi}" for i, (lo, hi) in enumerate(zip(edges[:-2], edges[1:-1]))]
    return [*inner, f"{edges[-2] + 1}+"]


def bin_ordinal(length: Column, edges: tuple[int, ...] = LENGTH_EDGES, open_ended: bool = False) -> Column:
    """Index of the bin ``(lo, hi]``, NULL outside all bins.

    ``open_ended`` takes what the labels promise instead: the first edge itself, and every length
    above the last but one edge.
    """
    above_first = (length >= edges[0]) if open_ended else (length > edges[0])
    inside = above_first if open_ended else above_first & (length <= edges[-1])
    ordinal = F.when(~inside | length.isNull(), None)
    for i, hi in enumerate(edges[1:-1]):
        ordinal = ordinal.when(length <= hi, i)
    return ordinal.otherwise(len(edges) - 2).cast("int")


def bin_label(ordinal: Column, edges: tuple[int, ...] = LENGTH_EDGES) -> Column:
    return F.try_element_at(F.array(*[F.lit(b) for b in bin_labels(edges)]), ordinal + 1)
