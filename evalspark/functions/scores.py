"""Classification scores as expressions over the four confusion counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "tn")


def ratio(numerator: str, denominator: str) -> str:
    """SQL of the quotient as double, 0 where the denominator is 0."""
    return f"coalesce(try_divide({numerator}, {denominator}), 0D)"


def scores(beta: float = 0.5, prefix: str = "") -> dict[str, Column]:
    """Score name to expression over ``<prefix>tp``, ``fp``, ``fn`` and ``tn``.

    The counts are cast to double first: products of four row counts overflow a long.
    """
    tp, fp, fn, tn = (f"CAST({prefix}{c} AS DOUBLE)" for c in COUNTS)
    positive, negative, flagged = f"({tp} + {fn})", f"({tn} + {fp})", f"({tp} + {fp})"
    recall, specificity = ratio(tp, positive), ratio(tn, negative)
    weight = beta * beta
    hits = f"{1 + weight}D * {tp}"
    expressions = {
        "accuracy": ratio(f"{tp} + {tn}", f"{positive} + {negative}"),
        "precision": ratio(tp, flagged),
        "recall": recall,
        "specificity": specificity,
        "f1": ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"),
        "fbeta": ratio(hits, f"{hits} + {weight}D * {fn} + {fp}"),
        "fp_rate": ratio(fp, negative),
        "mcc": ratio(
            f"{tp} * {tn} - {fp} * {fn}", f"sqrt({flagged} * {positive} * {negative} * ({tn} + {fn}))"
        ),
        "balanced_accuracy": f"CASE WHEN {positive} = 0 THEN {specificity} "
        f"WHEN {negative} = 0 THEN {recall} ELSE ({recall} + {specificity}) / 2 END",
        "g_mean": f"sqrt({recall} * {specificity})",
        "fp_share": f"try_divide({fp}, {flagged})",
    }
    return {name: F.expr(sql) for name, sql in expressions.items()}


def relative_change(small: Column, large: Column, lower_is_better: Column) -> Column:
    """Gain of ``large`` over ``small``, signed so that better is positive."""
    gain = F.when(lower_is_better, small - large).otherwise(large - small)
    return gain / F.greatest(F.lit(0.0001), small)
