"""Statistics from summaries of bounded size: quantiles per slice, and the most frequent values of a column.

Both are for columns with very many different values, where exact counts per value would shuffle them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Items that a level of a quantile sketch keeps. Ranks are then off by at most RANK_ERROR of all items, with 99 % certainty.
SKETCH_ITEMS, RANK_ERROR = 800, 0.0045


def quantile_sketches(items: DataFrame, by: Sequence[str], value: str = "text_length") -> DataFrame:
    """One row per slice: ``sketch``, ``n_items``, ``lowest`` and ``highest`` of the values that are not null.

    Rows are summarised before the shuffle, so a slice that holds a third of them costs no more than others.
    """
    kept = items.where(F.col(value).isNotNull()).withColumn("sketched", F.col(value).cast("long"))
    return kept.groupBy(*by).agg(
        F.kll_sketch_agg_bigint("sketched", F.lit(SKETCH_ITEMS)).alias("sketch"),
        F.count("*").alias("n_items"),
        F.min("sketched").alias("lowest"),
        F.max("sketched").alias("highest"),
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored sketches of finer slices, days or parts as those of coarser ones; no item is read again."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
        F.sum("n_items").alias("n_items"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
    )


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``sketches`` with ``share`` and ``quantile``, one row for each of ``shares``; 0 and 1 give the exact extremes."""

    def at(share: float) -> Column:
        inner = F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(share)))
        return F.col("lowest") if share <= 0 else F.col("highest") if share >= 1 else inner

    entries = [F.struct(F.lit(float(s)).alias("share"), at(s).alias("quantile")) for s in shares]
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, F.inline(F.array(*entries)))


def rank_errors(quantiles: DataFrame, items: DataFrame, by: Sequence[str], value: str = "text_length") -> DataFrame:
    """``quantiles`` with ``rank_error``: how far the share of items up to the value is from what was asked for.

    Items of the same value fill a stretch of ranks, and the error is 0 within it. Slices must be named by columns without
    nulls. This is the exact way, for checks: one row per slice and different value is shuffled.
    """
    counts = items.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("long").alias("v"))
    counts = counts.agg(F.count("*").alias("n"))
    keys = list(by)
    joined = quantiles.join(counts, keys) if keys else quantiles.crossJoin(F.broadcast(counts))
    ranks = joined.groupBy(*keys, "share", "quantile", "n_items").agg(
        F.sum(F.when(F.col("v") < F.col("quantile"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("v") <= F.col("quantile"), F.col("n")).otherwise(0)).alias("up_to"),
    )
    low, high = F.col("below") / F.col("n_items"), F.col("up_to") / F.col("n_items")
    error = F.greatest(low - F.col("share"), F.col("share") - high, F.lit(0.0))
    return ranks.select(*keys, "share", "quantile", "n_items", error.alias("rank_error"))


# A summary that tracks m values misses a value of at most this many m-ths of all rows.
MISSED = 3.5


def top_values(items: DataFrame, column: str, n: int, tracked: int = 8192) -> DataFrame:
    """The ``n`` most frequent values of ``column`` and their exact ``n_items``; ties go to the smaller value.

    A summary of at most ``tracked`` values, built before the shuffle, proposes candidates, which alone are counted. A value
    that is no candidate occurs at most ``MISSED`` / ``tracked`` times as often as there are rows; if the n-th candidate
    is more frequent than that, the list is complete. If not, all values are counted. Nulls are no values. Reads
    the items twice, the column alone; what is broadcast is the list of candidates.
    """
    if not 0 < n <= tracked:
        raise ValueError("n must be between 1 and the number of tracked values")
    values = items.where(F.col(column).isNotNull()).select(column)
    summary = values.agg(
        F.expr(f"approx_top_k(`{column}`, {tracked}, {tracked})").alias("top"), F.count("*").alias("n_rows")
    )
    found = summary.select("n_rows", F.col("top")["item"].alias("candidates"))
    found = found.first()
    if not found["n_rows"]:
        return values.groupBy(column).agg(F.count("*").alias("n_items"))
    kinds = values.schema
    candidates = values.sparkSession.createDataFrame([(v,) for v in found["candidates"]], kinds)

    def first(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy(column).agg(F.count("*").alias("n_items"))
        return counted.orderBy(F.desc("n_items"), column).limit(n)

    exact = first(values.join(F.broadcast(candidates), column, "left_semi"))
    # At most ``n`` rows, which the next line needs anyway.
    rows = exact.collect()
    everything = len(found["candidates"]) < tracked and sum(r["n_items"] for r in rows) == found["n_rows"]
    if everything or (len(rows) == n and rows[-1]["n_items"] * tracked > MISSED * found["n_rows"]):
        return values.sparkSession.createDataFrame(rows, exact.schema).coalesce(1)
    return first(values)
