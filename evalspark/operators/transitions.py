"""False positives that a second model fixes, introduces or keeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.counting import count_where
from evalspark.schemas import Variant

CATEGORIES = ("fixed", "introduced", "persistent")


def is_false_positive(truth: Column, pred: Column) -> Column:
    """True for a flagged negative; a missing label or answer is not one."""
    return F.coalesce((truth == 0) & (pred == 1), F.lit(False))


def fp_rows(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("truth") == 0) & (F.col("pred") == 1))


def fp_flags(wide: DataFrame, variants: Sequence[Variant]) -> DataFrame:
    """Add a 0/1 false-positive flag per variant to the wide table."""
    return wide.withColumns(
        {
            f"{v.name}_fp": is_false_positive(F.col("truth"), F.col(v.name)).cast("int")
            for v in variants
        }
    )


def _change(truth: Column, small: Column, large: Column) -> Column:
    """Category of a negative answered by both models, NULL where there is no false positive."""
    negative = truth == 0
    return (
        F.when(negative & (small == 1) & (large == 0), "fixed")
        .when(negative & (small == 0) & (large == 1), "introduced")
        .when(negative & (small == 1) & (large == 1), "persistent")
    )


def fp_changes(
    wide: DataFrame, definitions: Sequence[str], small: str, large: str, keep: Sequence[str]
) -> DataFrame:
    """One row per item and definition whose false positive was fixed, introduced or kept."""
    entries = [
        F.struct(
            F.lit(d).alias("definition"),
            _change(
                F.col("truth"), F.col(Variant(d, small).name), F.col(Variant(d, large).name)
            ).alias("category"),
        )
        for d in definitions
    ]
    return wide.select(*keep, F.inline(F.array(*entries))).where(F.col("category").isNotNull())


def fp_transitions(
    wide: DataFrame,
    definitions: Sequence[str],
    small: str,
    large: str,
    weight: str | None = None,
) -> DataFrame:
    """Counts per category (rows) and definition (columns); empty cells are 0.

    All counts come from one aggregate over the wide table, and are laid out afterwards.
    """
    change = {
        d: _change(F.col("truth"), F.col(Variant(d, small).name), F.col(Variant(d, large).name))
        for d in definitions
    }
    counted = wide.agg(
        *[
            count_where(change[d] == c, weight).alias(f"{d}_{c}")
            for d in definitions
            for c in CATEGORIES
        ]
    )
    entries = [
        F.struct(F.lit(c).alias("category"), *[F.col(f"{d}_{c}").alias(d) for d in definitions])
        for c in CATEGORIES
    ]
    return counted.select(F.inline(F.array(*entries)))


def review_rows(changes: DataFrame, category: str, texts: DataFrame | None = None) -> DataFrame:
    """The items behind one category, for reading.

    Where ``changes`` does not keep the text, it comes from ``texts``, a table with one row per item, with
    whatever other columns that has, and is joined only after the filter.
    """
    wanted = changes.where(F.col("category") == category)
    if texts is None:
        return wanted
    more = [c for c in texts.columns if c not in wanted.columns]
    return wanted.join(texts.select("item_id", *more), "item_id")
