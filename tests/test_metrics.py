import math

import pytest
from helpers import A_L, A_S, ROW, VARIANTS, by, cells, expand
from pyspark.sql import functions as F

from evalspark.functions.scores import scores
from evalspark.operators import evaluate
from evalspark.operators.profile import WEIGHT, answer_profile
from evalspark.operators.merge import unpivot_predictions
from evalspark.operators.transitions import fp_flags, fp_transitions


def _one(spark, tp, fp, fn, tn):
    rows = expand(spark, cells(A_S, tp, fp, fn, tn), ROW)
    return evaluate.classification_metrics(rows).first()


def test_no_rows(spark):
    empty = spark.createDataFrame([], ROW)
    assert evaluate.classification_metrics(empty).count() == 0
    overall = evaluate.classification_metrics(empty, by=[]).first()
    assert overall.tp == 0 and overall.accuracy == 0.0 and overall.mcc == 0.0
    assert overall.fp_share is None


@pytest.mark.parametrize(
    ("counts", "expected"),
    [
        ((0, 0, 0, 7), {"accuracy": 1, "precision": 0, "recall": 0, "specificity": 1, "balanced_accuracy": 1}),
        ((5, 0, 3, 0), {"recall": 5 / 8, "specificity": 0, "fp_rate": 0, "balanced_accuracy": 5 / 8}),
        ((4, 6, 0, 0), {"precision": 0.4, "fp_rate": 1, "mcc": 0, "fp_share": 0.6, "g_mean": 0}),
        ((0, 0, 4, 6), {"precision": 0, "f1": 0, "fbeta": 0, "mcc": 0, "fp_share": None}),
        ((9, 0, 0, 9), {"mcc": 1, "f1": 1, "fbeta": 1, "g_mean": 1, "total_errors": 0}),
    ],
)
def test_degenerate(spark, counts, expected):
    row = _one(spark, *counts)
    assert {k: row[k] for k in expected} == expected


def test_missing_answers(spark):
    rows = spark.createDataFrame(
        [("A", "S", 1, None), ("A", "S", 0, None), ("A", "S", None, 1), ("A", "S", 1, 1)], ROW
    )
    row = evaluate.confusion_matrix(rows).first()
    assert (row.tp, row.fp, row.fn, row.tn, row.n_unscored) == (1, 0, 0, 0, 2)


def test_large_counts(spark):
    """Products of four row counts of this size do not fit a long."""
    n = 3_000_000_000
    counts = spark.createDataFrame([(2 * n, n, n, 3 * n)], "tp long, fp long, fn long, tn long")
    row = counts.select(*[e.alias(k) for k, e in scores().items()]).first()
    assert row.mcc == pytest.approx((6 - 1) / math.sqrt(3 * 3 * 4 * 4))


def test_beta(spark):
    rows = expand(spark, cells(A_S, 3, 1, 2, 4), ROW)
    row = evaluate.classification_metrics(rows, beta=2.0).first()
    precision, recall = 3 / 4, 3 / 5
    assert row.fbeta == pytest.approx(5 * precision * recall / (4 * precision + recall))


def test_rollup_matches_each_level(spark):
    groups = [
        (v.definition, v.model, t, p, k, b, (i + t + 2 * p) % 5)
        for i, (v, k, b) in enumerate((v, k, b) for v in (A_S, A_L) for k in ("x", "y", None) for b in ("s", "l"))
        for t in (0, 1)
        for p in (0, 1)
    ]
    rows = expand(spark, groups, ROW + ", keyword string, size string")
    rolled = evaluate.metrics_rollup(rows, ["size", "keyword"]).cache()
    for level, columns in enumerate([[], ["size"], ["size", "keyword"]]):
        direct = evaluate.classification_metrics(rows, ["definition", "model", *columns])
        part = rolled.where(F.col("level") == level).select(*direct.columns)
        assert sorted(map(str, part.collect())) == sorted(map(str, direct.collect()))


def test_profile_gives_the_same_counts(spark):
    wide = spark.range(5000).select(
        (F.col("id") % 2).cast("int").alias("truth"),
        F.concat(F.lit("k"), F.col("id") % 3).alias("keyword"),
        (F.col("id") % 50).cast("int").alias("text_length"),
        *[
            F.when(F.col("id") % (7 + i) != 0, (F.col("id") % (3 + i) == 0).cast("int")).alias(v.name)
            for i, v in enumerate(VARIANTS)
        ],
    )
    profile = answer_profile(wide, VARIANTS)
    keep = ["truth", "keyword", "text_length"]
    direct = evaluate.confusion_matrix(unpivot_predictions(wide, VARIANTS, keep))
    weighed = evaluate.confusion_matrix(
        unpivot_predictions(profile, VARIANTS, [*keep, WEIGHT]), weight=WEIGHT
    )
    assert by(direct.collect(), "definition", "model") == by(weighed.collect(), "definition", "model")
    assert (
        fp_transitions(wide, ["A", "B"], "S", "L").collect()
        == fp_transitions(profile, ["A", "B"], "S", "L", WEIGHT).collect()
    )


def test_transitions_add_up_and_skip_missing(spark):
    wide = spark.createDataFrame(
        [(0, 1, 0), (0, 1, None), (0, None, 1), (0, 1, 1), (0, 0, 1), (1, 1, 0), (None, 1, 0)],
        "truth int, A_S int, A_L int",
    )
    found = {r.category: r.A for r in fp_transitions(wide, ["A"], "S", "L").collect()}
    assert found == {"fixed": 1, "introduced": 1, "persistent": 1}
    flags = fp_flags(wide, [A_S, A_L]).select("A_S_fp", "A_L_fp").collect()
    assert [tuple(r) for r in flags] == [(1, 0), (1, 0), (0, 1), (1, 1), (0, 1), (0, 0), (0, 0)]
