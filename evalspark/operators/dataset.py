"""Statistics of the dataset itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.counting import count_rows, count_where
from evalspark.schemas import Variant


def dataset_overview(items: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: items, labelled items, both classes and the share of positives among the labelled."""
    truth = F.col("truth")
    return items.agg(
        count_rows(weight).alias("n_items"),
        count_where(truth.isNotNull(), weight).alias("n_labelled"),
        count_where(truth == 1, weight).alias("n_positive"),
        count_where(truth == 0, weight).alias("n_negative"),
    ).withColumn("positive_share", F.try_divide("n_positive", "n_labelled"))


def keyword_counts(items: DataFrame, weight: str | None = None) -> DataFrame:
    counts = items.where(F.col("keyword").isNotNull()).groupBy("keyword")
    return counts.agg(count_rows(weight).alias("n_items")).orderBy(F.desc("n_items"), "keyword")


def keyword_positive_rate(
    items: DataFrame, min_items: int = 10, weight: str | None = None
) -> DataFrame:
    """Share of positives per keyword with enough labelled items, highest first."""
    truth = F.col("truth")
    return (
        items.where(F.col("keyword").isNotNull())
        .groupBy("keyword")
        .agg(
            count_where(truth.isNotNull(), weight).alias("n_items"),
            count_where(truth == 1, weight).alias("n_positive"),
        )
        .where(F.col("n_items") >= min_items)
        .select("keyword", "n_items", F.try_divide("n_positive", "n_items").alias("positive_rate"))
        .orderBy(F.desc("positive_rate"), "keyword")
    )


def _length_frequencies(items: DataFrame, weight: str | None) -> DataFrame:
    """Items per distinct length: as many rows as there are lengths, whatever the number of items."""
    lengths = items.where(F.col("text_length").isNotNull()).groupBy("text_length")
    return lengths.agg(count_rows(weight).alias("n"))


def length_stats(items: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean, exact median and extremes of the text length, from the length frequencies."""
    length, n = F.col("text_length"), F.col("n")
    return _length_frequencies(items, weight).agg(
        F.sum("n").alias("n_items"),
        F.try_divide(F.sum(length.cast("double") * n), F.sum("n")).alias("mean_length"),
        F.percentile(length, 0.5, n).alias("median_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
    )


def length_histogram(items: DataFrame, bins: int = 20, weight: str | None = None) -> DataFrame:
    """Equal-width bins from the shortest to the longest text, the last one closed on both sides.

    Every bin is listed, empty ones with 0. Where all texts are equally long, the range is that length
    plus and minus one half.
    """
    frequencies = _length_frequencies(items, weight)
    bounds = frequencies.agg(
        F.struct(
            F.min("text_length").cast("double").alias("lo"),
            F.max("text_length").cast("double").alias("hi"),
        ).alias("range")
    )
    half = F.when(F.col("range.lo") == F.col("range.hi"), 0.5).otherwise(0.0)
    lo = (F.col("range.lo") - half).alias("lo")
    width = ((F.col("range.hi") - F.col("range.lo") + 2 * half) / bins).alias("width")
    ranged = frequencies.withColumn("range", bounds.scalar())
    place = F.floor((F.col("text_length") - F.col("lo")) / F.col("width"))
    filled = (
        ranged.select("text_length", "n", lo, width)
        .withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    edges = (
        items.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"), bounds.scalar().alias("range"))
        .select("bin", lo, width)
        .where(F.col("lo").isNotNull())
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        )
    )
    return edges.join(filled, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n_items")
    )


def run_summary(
    items: DataFrame,
    variants: Sequence[Variant],
    comparison: DataFrame,
    improvement: DataFrame,
    transitions: DataFrame,
    weight: str | None = None,
) -> DataFrame:
    """One row with the class counts, the variants, and the three result tables as nested values.

    The result tables have one row per metric or category, so a single value holds each.
    """

    def nested(table: DataFrame, key: str):
        values = [c for c in table.columns if c != key]
        entry = F.struct(F.col(key), F.struct(*values))
        return table.agg(F.map_from_entries(F.sort_array(F.collect_list(entry)))).scalar()

    return dataset_overview(items, weight).select(
        "*",
        F.array(*[F.lit(v.name) for v in variants]).alias("variants"),
        nested(comparison, "metric").alias("comparison"),
        nested(improvement, "metric").alias("improvement"),
        nested(transitions, "category").alias("fp_changes"),
    )
