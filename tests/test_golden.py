"""Published results, reproduced from the counts behind them."""

import pytest
from helpers import A_L, A_S, B_L, B_S, ROW, VARIANTS, by, cells, expand

from evalspark.functions.bins import LENGTH_EDGES, bin_labels
from evalspark.operators import evaluate, slices, transitions

COUNTS = {
    A_S: (630, 2000, 620, 3691),
    A_L: (1131, 3165, 119, 2526),
    B_S: (562, 1722, 688, 3969),
    B_L: (1107, 3068, 143, 2623),
}
# metric: A_S, A_L, B_S, B_L
COMPARISON = {
    "precision": (0.23954372623574144, 0.263268156424581, 0.24605954465849386, 0.2651497005988024),
    "specificity": (0.648567914250571, 0.44385872430152873, 0.6974169741697417, 0.46090318046037604),
    "fp_rate": (0.3514320857494289, 0.5561412756984713, 0.3025830258302583, 0.539096819539624),
    "fbeta": (0.2676295666949872, 0.30677009873060646, 0.2705565183901406, 0.30835654596100276),
    "f1": (0.3247422680412371, 0.4078615218175261, 0.3180531975099038, 0.4081105990783411),
    "recall": (0.504, 0.9048, 0.4496, 0.8856),
}
# metric: A, B
IMPROVEMENT = {
    "precision": (0.09904008158198108, 0.07758348072538197),
    "specificity": (-0.31563261988620966, -0.3391282438901486),
    "fp_rate": (-0.5825, -0.7816492450638791),
    "fbeta": (0.14624890859023443, 0.13971213037401217),
    "f1": (0.25595452750158826, 0.2831520081342147),
    "recall": (0.7952380952380953, 0.9697508896797155),
}
# category: A, B
TRANSITIONS = {"fixed": (345, 332), "introduced": (1510, 1678), "persistent": (1655, 1390)}
# false positives per length bin for A_S, A_L, B_S, B_L, after items and negatives
BY_LENGTH = [
    (625, 376, 107, 235, 91, 232),
    (958, 783, 247, 479, 228, 462),
    (1314, 1078, 410, 687, 337, 669),
    (768, 644, 231, 341, 187, 327),
    (780, 634, 224, 320, 196, 315),
    (1243, 1095, 376, 512, 319, 501),
    (1146, 1004, 374, 544, 333, 514),
    (82, 59, 24, 39, 28, 35),
    (8, 6, 3, 3, 1, 4),
    (17, 12, 4, 5, 2, 9),
]
# keyword: items, negatives, then false positives for A_S, A_L, B_S, B_L
BY_KEYWORD = {
    "k1": (529, 62, 53, 62, 39, 61),
    "k2": (283, 186, 94, 182, 76, 179),
    "k3": (4605, 4122, 1726, 2596, 1483, 2547),
    "k4": (1524, 1321, 127, 325, 124, 281),
}
# metric: A original, A with cut-off, B original, B with cut-off
CUTOFF = {
    "accuracy": (0.5270133986457283, 0.5268024851900014, 0.537386543725688, 0.5377290434280767),
    "precision": (0.26332945285215364, 0.2628998365631567, 0.2651497005988024, 0.2652424387902064),
    "recall": (0.9048, 0.905144694533762, 0.8856, 0.8854166666666666),
    "f1": (0.4079350766456266, 0.40745431518002534, 0.4081105990783411, 0.40820096047284815),
    "balanced_accuracy": (0.6744172201722017, 0.6745205593507281, 0.6732515902301881, 0.6733963502258197),
    "mcc": (0.2759892405887022, 0.27595279450302895, 0.2719582242272864, 0.27211900081490353),
    "specificity": (0.4440344403444034, 0.4438964241676942, 0.46090318046037604, 0.4613760337849727),
    "g_mean": (0.6338472699504323, 0.6338694607392731, 0.6388864191823997, 0.6391478936160064),
}
CUTOFF_COUNTS = {
    "A": ((1131, 3164, 119, 2527), (1126, 3157, 118, 2520)),
    "B": ((1107, 3068, 143, 2623), (1105, 3061, 143, 2622)),
}


@pytest.fixture(scope="module")
def scored(spark):
    rows = expand(spark, [g for v, c in COUNTS.items() for g in cells(v, *c)], ROW)
    return evaluate.classification_metrics(rows).cache()


def test_comparison(scored):
    found = by(evaluate.metric_comparison(scored, VARIANTS).collect(), "metric")
    assert set(found) == set(COMPARISON)
    for metric, values in COMPARISON.items():
        for variant, value in zip(VARIANTS, values):
            assert found[metric][variant.name] == pytest.approx(value, rel=1e-12)


def test_improvement(scored):
    found = by(evaluate.metric_improvement(scored, ["A", "B"], "S", "L").collect(), "metric")
    for metric, values in IMPROVEMENT.items():
        for definition, value in zip("AB", values):
            assert found[metric][definition] == pytest.approx(value, rel=1e-12)


def test_transitions(spark):
    both = {"fixed": (1, 0), "introduced": (0, 1), "persistent": (1, 1)}
    groups = [
        (0, *(both[c] if d == "A" else (0, 0)), *(both[c] if d == "B" else (0, 0)), n)
        for c, counts in TRANSITIONS.items()
        for d, n in zip("AB", counts)
    ]
    wide = expand(spark, groups, "truth int, A_S int, A_L int, B_S int, B_L int")
    found = by(transitions.fp_transitions(wide, ["A", "B"], "S", "L").collect(), "category")
    assert {c: (r["A"], r["B"]) for c, r in found.items()} == TRANSITIONS


def _slice_groups(key, items, negatives, fps):
    for variant, fp in zip(VARIANTS, fps):
        for truth, pred, n in ((0, 1, fp), (0, 0, negatives - fp), (1, 0, items - negatives)):
            yield (variant.definition, variant.model, truth, pred, key, n)


@pytest.mark.parametrize("upper", [False, True])
def test_by_length(spark, upper):
    groups = []
    for i, (items, negatives, *fps) in enumerate(BY_LENGTH):
        length = LENGTH_EDGES[i + 1] if upper else LENGTH_EDGES[i] + 1
        groups += _slice_groups(length, items, negatives, fps)
    rows = expand(spark, groups, ROW + ", text_length int")
    found = by(slices.fp_by_length(rows).collect(), "length_bin", "definition", "model")
    assert len(found) == 40
    for label, (items, negatives, *fps) in zip(bin_labels(LENGTH_EDGES), BY_LENGTH):
        for variant, fp in zip(VARIANTS, fps):
            row = found[label, *variant]
            assert (row["n_items"], row["n_negative"], row["n_fp"]) == (items, negatives, fp)
            assert row["fp_rate"] == pytest.approx(fp / negatives, rel=1e-12)


def test_by_keyword(spark):
    groups = [g for k, (n, neg, *fps) in BY_KEYWORD.items() for g in _slice_groups(k, n, neg, fps)]
    rows = expand(spark, groups, ROW + ", keyword string")
    by_keyword = slices.fp_by_keyword(rows)
    found = by(by_keyword.collect(), "keyword", "definition", "model")
    for keyword, (items, negatives, *fps) in BY_KEYWORD.items():
        for variant, fp in zip(VARIANTS, fps):
            row = found[keyword, *variant]
            assert (row["n_items"], row["n_negative"], row["n_fp"]) == (items, negatives, fp)
    ordered = slices.highest_rate_first(by_keyword, "keyword").collect()
    assert [r["keyword"] for r in ordered] == ["k1", "k2", "k3", "k4"] * 4
    top = slices.top_keywords(by_keyword, 2).collect()
    assert {(r["keyword"], r["rank"]) for r in top} == {("k1", 1), ("k2", 2)}


@pytest.mark.parametrize("which", [0, 1])
def test_cutoff(spark, which):
    """The published columns are not nested, so each is reproduced from counts of its own."""
    groups = [g for d, c in CUTOFF_COUNTS.items() for g in cells(type(A_S)(d, "L"), *c[which])]
    rows = expand(spark, groups, ROW).selectExpr("*", "10 AS text_length")
    found = by(
        evaluate.length_cutoff_metrics(rows, {"A": 10, "B": 10}).collect(), "metric", "definition"
    )
    for metric, values in CUTOFF.items():
        for i, definition in enumerate("AB"):
            row = found[metric, definition]
            assert row["original"] == row["with_cutoff"]
            assert row["original"] == pytest.approx(values[2 * i + which], rel=1e-12)
