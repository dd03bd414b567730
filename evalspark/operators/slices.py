"""False-positive rates by length bin, keyword or any other column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.bins import LENGTH_EDGES, bin_label, bin_ordinal
from evalspark.functions.counting import count_rows, count_where
from evalspark.functions.scores import ratio
from evalspark.schemas import Variant


def length_bins(
    df: DataFrame, edges: tuple[int, ...] = LENGTH_EDGES, open_ended: bool = False
) -> DataFrame:
    """Add ``bin_ordinal`` and ``length_bin``; both NULL outside the bins."""
    return df.withColumn(
        "bin_ordinal", bin_ordinal(F.col("text_length"), edges, open_ended)
    ).withColumn("length_bin", bin_label(F.col("bin_ordinal"), edges))


def fp_by_slice(
    rows: DataFrame, slices: Sequence[str], min_items: int = 1, weight: str | None = None
) -> DataFrame:
    """Items, negatives, false positives and their rate per slice and variant.

    Slices with a NULL value, fewer than ``min_items`` rows or no negative are left out.
    """
    truth, pred = F.col("truth"), F.col("pred")
    return (
        rows.dropna(subset=list(slices))
        .groupBy(*slices, "definition", "model")
        .agg(
            count_rows(weight).alias("n_items"),
            count_where(truth == 0, weight).alias("n_negative"),
            count_where((truth == 0) & (pred == 1), weight).alias("n_fp"),
        )
        .where((F.col("n_negative") > 0) & (F.col("n_items") >= min_items))
        .withColumn("fp_rate", F.expr(ratio("n_fp", "n_negative")))
    )


def fp_by_length(
    rows: DataFrame,
    edges: tuple[int, ...] = LENGTH_EDGES,
    open_ended: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """``fp_by_slice`` over the length bins; ``bin_ordinal`` gives their order."""
    binned = length_bins(rows, edges, open_ended)
    return fp_by_slice(binned, ["bin_ordinal", "length_bin"], weight=weight)


def fp_by_keyword(rows: DataFrame, min_items: int = 5, weight: str | None = None) -> DataFrame:
    return fp_by_slice(rows, ["keyword"], min_items, weight)


def highest_rate_first(by_slice: DataFrame, tie: str) -> DataFrame:
    return by_slice.orderBy("definition", "model", F.desc("fp_rate"), tie)


def top_keywords(by_keyword: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` keywords with the highest rate per variant; ties go to the smaller keyword."""
    ranked = Window.partitionBy("definition", "model").orderBy(F.desc("fp_rate"), "keyword")
    return by_keyword.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def fp_length_curve(by_length: DataFrame, variants: Sequence[Variant]) -> DataFrame:
    """Rates with bins as rows and one series per variant as columns."""
    return (
        by_length.withColumn("variant", F.concat_ws("_", "definition", "model"))
        .groupBy("bin_ordinal", "length_bin")
        .pivot("variant", [v.name for v in variants])
        .agg(F.max("fp_rate"))
        .orderBy("bin_ordinal")
    )


def filter_keywords(rows: DataFrame, keywords: Sequence[str] | DataFrame) -> DataFrame:
    """Rows with one of the keywords, given as a list or, when long, as a one-column table."""
    if isinstance(keywords, DataFrame):
        return rows.join(keywords.select("keyword"), "keyword", "left_semi")
    return rows.where(F.col("keyword").isin(list(keywords)))
