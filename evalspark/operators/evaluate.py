"""Confusion counts and the scores built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.counting import count_where
from evalspark.functions.scores import COUNTS, relative_change, scores
from evalspark.schemas import Variant

BY_VARIANT = ("definition", "model")
REPORTED = ("precision", "specificity", "fp_rate", "fbeta", "f1", "recall")
CUTOFF_REPORTED = (
    "accuracy",
    "precision",
    "recall",
    "f1",
    "balanced_accuracy",
    "mcc",
    "specificity",
    "g_mean",
)


def _cells(
    weight: str | None, prefix: str = "", keep: Column | None = None
) -> list[Column]:
    truth, pred = F.col("truth"), F.col("pred")
    keep = F.lit(True) if keep is None else keep
    return [
        count_where(keep & (truth == 1) & (pred == 1), weight).alias(prefix + "tp"),
        count_where(keep & (truth == 0) & (pred == 1), weight).alias(prefix + "fp"),
        count_where(keep & (truth == 1) & (pred == 0), weight).alias(prefix + "fn"),
        count_where(keep & (truth == 0) & (pred == 0), weight).alias(prefix + "tn"),
    ]


def confusion_matrix(
    rows: DataFrame, by: Sequence[str] = BY_VARIANT, weight: str | None = None
) -> DataFrame:
    """The four counts per group, with the answers that were missing, unclear or failed beside them.

    Rows without a label or without an answer are in none of the four counts. Counting combines
    before the shuffle, so the size of a group does not matter. ``weight`` names a column that says how
    many rows each row stands for.
    """
    labelled = F.col("truth").isNotNull()
    extra = [count_where(labelled & F.col("pred").isNull(), weight).alias("n_unscored")]
    if "decision" in rows.columns:
        extra += [
            count_where(labelled & (F.col("decision") == "Unclear"), weight).alias("n_unclear"),
            count_where(labelled & (F.col("decision") == "Error"), weight).alias("n_error"),
        ]
    return rows.groupBy(*by).agg(*_cells(weight), *extra)


def roll_up(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coarser counts from finer ones, summing every count column."""
    measures = [c for c in (*COUNTS, "n_unscored", "n_unclear", "n_error") if c in counts.columns]
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in measures])


def score(counts: DataFrame, beta: float = 0.5) -> DataFrame:
    """Add every score to a table of counts."""
    return counts.withColumns(
        {
            **scores(beta),
            "predicted_positive": F.col("tp") + F.col("fp"),
            "total_errors": F.col("fp") + F.col("fn"),
        }
    )


def classification_metrics(
    rows: DataFrame,
    by: Sequence[str] = BY_VARIANT,
    beta: float = 0.5,
    weight: str | None = None,
) -> DataFrame:
    return score(confusion_matrix(rows, by, weight), beta)


def metrics_rollup(
    rows: DataFrame, slices: Sequence[str], beta: float = 0.5, weight: str | None = None
) -> DataFrame:
    """Scores per slice, per prefix of the slice columns, and overall, for every variant.

    ``level`` says how many slice columns are set. The rows are counted once, at the finest grain; the
    levels above are sums over that small table.
    """
    finest = confusion_matrix(rows, [*BY_VARIANT, *slices], weight)
    entries = [
        F.struct(
            F.lit(level).alias("level"),
            *[
                (F.col(c) if i < level else F.lit(None).cast(finest.schema[c].dataType)).alias(c)
                for i, c in enumerate(slices)
            ],
        )
        for level in range(len(slices) + 1)
    ]
    others = [c for c in finest.columns if c not in slices]
    leveled = finest.select(*others, F.inline(F.array(*entries)))
    return score(roll_up(leveled, [*BY_VARIANT, "level", *slices]), beta)


def _unpivot_scores(scored: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return scored.unpivot(list(keep), list(names), "metric", "value")


def metric_comparison(
    scored: DataFrame, variants: Sequence[Variant], metrics: Sequence[str] = REPORTED
) -> DataFrame:
    """Metrics as rows, variants as columns."""
    named = scored.withColumn("variant", F.concat_ws("_", "definition", "model"))
    return (
        _unpivot_scores(named, metrics, ["variant"])
        .groupBy("metric")
        .pivot("variant", [v.name for v in variants])
        .agg(F.max("value"))
    )


def metric_improvement(
    scored: DataFrame,
    definitions: Sequence[str],
    small: str,
    large: str,
    metrics: Sequence[str] = REPORTED,
) -> DataFrame:
    """Relative gain of the large model over the small one; metrics as rows, definitions as columns."""
    paired = (
        _unpivot_scores(scored, metrics, ["definition", "model"])
        .groupBy("metric", "definition")
        .agg(
            F.max(F.when(F.col("model") == small, F.col("value"))).alias("small"),
            F.max(F.when(F.col("model") == large, F.col("value"))).alias("large"),
        )
    )
    gain = relative_change(F.col("small"), F.col("large"), F.col("metric") == "fp_rate")
    return paired.groupBy("metric").pivot("definition", list(definitions)).agg(F.max(gain))


def length_cutoff_metrics(
    rows: DataFrame,
    cutoffs: Mapping[str, int],
    metrics: Sequence[str] = CUTOFF_REPORTED,
    by: Sequence[str] = BY_VARIANT,
    weight: str | None = None,
) -> DataFrame:
    """Each metric over all items and over those no longer than the definition's cut-off, in one scan."""
    cutoff = F.lit(None).cast("long")
    for d, limit in cutoffs.items():
        cutoff = F.when(F.col("definition") == d, F.lit(limit).cast("long")).otherwise(cutoff)
    counted = rows.groupBy(*by).agg(
        *_cells(weight, "all_"), *_cells(weight, "cut_", F.col("text_length") <= cutoff)
    )
    full, cut = scores(prefix="all_"), scores(prefix="cut_")
    entries = [
        F.struct(F.lit(m).alias("metric"), full[m].alias("original"), cut[m].alias("with_cutoff"))
        for m in metrics
    ]
    return counted.select(*by, F.inline(F.array(*entries)))


# Lengths that are summed as one range first.
CUTOFF_RANGE = 1024


def length_cutoff_curve(
    rows: DataFrame, by: Sequence[str] = BY_VARIANT, weight: str | None = None, beta: float = 0.5
) -> DataFrame:
    """Every score at every cut-off that makes a difference, in one pass over the rows.

    One row per group and length that occurs among the rows with a label and an answer: ``cutoff``, the counts over the
    items no longer than that, ``n_kept`` and ``share_kept`` of them, and the scores. Rows are counted by length before the
    shuffle. Prefix sums then run over ranges of lengths and, apart from that, within each range, so a task sees one
    range of lengths or one row per range, however many lengths there are. Items without a length are in no row.
    """
    keys = list(by)
    counted = rows.where("truth IS NOT NULL AND pred IS NOT NULL AND text_length IS NOT NULL")
    cells = counted.groupBy(*keys, F.col("text_length").cast("long").alias("cutoff")).agg(*_cells(weight))
    cells = cells.withColumn("range", F.floor(F.col("cutoff") / CUTOFF_RANGE))
    ranges = cells.groupBy(*keys, "range").agg(*[F.sum(c).alias(f"{c}_range") for c in COUNTS])
    whole = Window.partitionBy(*keys)
    shorter = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *keys,
        "range",
        *[F.coalesce(F.sum(f"{c}_range").over(shorter), F.lit(0)).alias(f"{c}_before") for c in COUNTS],
        F.sum(F.expr(" + ".join(f"{c}_range" for c in COUNTS))).over(whole).alias("n_all"),
    )
    within = Window.partitionBy(*keys, "range").orderBy("cutoff").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"cells.{k}").eqNullSafe(F.col(f"ranges.{k}")) for k in (*keys, "range")]
    joined = cells.alias("cells").join(ranges.alias("ranges"), same).select(
        "cells.*", *[f"{c}_before" for c in COUNTS], "n_all"
    )
    summed = joined.select(
        *keys, "cutoff", "n_all", *[(F.sum(c).over(within) + F.col(f"{c}_before")).alias(c) for c in COUNTS]
    )
    kept = summed.withColumn("n_kept", F.expr(" + ".join(COUNTS)))
    return score(kept.withColumn("share_kept", F.col("n_kept") / F.col("n_all")).drop("n_all"), beta)


def best_length_cutoff(
    curve: DataFrame,
    metric: str,
    by: Sequence[str] = BY_VARIANT,
    lowest: bool = False,
    min_share: float = 0.0,
) -> DataFrame:
    """The cut-off of each group at which ``metric`` is best, and what it gains over all items.

    Of equal scores the longest cut-off wins, as it keeps most items. ``min_share`` asks for cut-offs that keep at least
    that share of the items; ``lowest`` looks for the smallest value, as for ``fp_rate``. Undefined scores are never best. An
    arg-max combines before the shuffle, so the number of cut-offs does not matter. Pass ``by=["definition"]`` on a curve of
    all models to choose one cut-off per definition.
    """
    worth = -F.col(metric) if lowest else F.col(metric)
    rank = F.when(
        F.col(metric).isNotNull() & (F.col("share_kept") >= min_share), F.struct(worth.alias("worth"), "cutoff")
    )
    best = {c: F.max_by(c, rank).alias(c) for c in ("cutoff", "n_kept", "share_kept")}
    return curve.groupBy(*by).agg(
        *best.values(),
        F.max_by(metric, rank).alias("with_cutoff"),
        F.max_by(metric, "cutoff").alias("original"),
    )
