"""Measure the answers of all variants against the labels, and explain the false positives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from evalspark.functions.bins import LENGTH_EDGES
from evalspark.operators.dataset import (
    dataset_overview,
    keyword_counts,
    keyword_positive_rate,
    length_histogram,
    length_stats,
    run_summary,
)
from evalspark.operators.evaluate import (
    best_length_cutoff,
    classification_metrics,
    length_cutoff_curve,
    metric_comparison,
    metric_improvement,
)
from evalspark.operators.merge import unpivot_predictions
from evalspark.operators.profile import WEIGHT, answer_profile
from evalspark.operators.slices import (
    fp_by_keyword,
    fp_by_length,
    fp_length_curve,
    highest_rate_first,
    top_keywords,
)
from evalspark.operators.topics import fit_topics, fp_tokens, topic_counts, topic_examples
from evalspark.operators.transitions import fp_changes, fp_transitions, review_rows
from evalspark.schemas import Variant
from evalspark.session import materialize
from evalspark.sources.writers import write_report, write_table


def analyze(
    wide: DataFrame,
    variants: Sequence[Variant],
    small: str,
    large: str,
    output: str,
    *,
    edges: tuple[int, ...] = LENGTH_EDGES,
    topics: int | None = None,
    texts: DataFrame | None = None,
    cutoff_metric: str = "f1",
) -> dict[str, DataFrame]:
    """All result tables for a comparative table, written under ``output`` and returned by name.

    ``wide`` has one row per item and an answer column per variant. All counts come from one pass over
    its narrow columns, the profile; only review rows and topics need the text, either a column of
    ``wide``, so that nothing is joined, or from ``texts``, a table with one row per item.
    ``topics`` asks for that many topics per variant. Review rows keep all columns of ``wide`` and of ``texts``.
    ``length_cutoffs`` has the cut-off of each variant at which ``cutoff_metric`` is best.
    """
    definitions = list(dict.fromkeys(v.definition for v in variants))
    profile = materialize(answer_profile(wide, variants), "profile")
    rows = unpivot_predictions(profile, variants, ["truth", "keyword", "text_length", WEIGHT])

    scored = materialize(classification_metrics(rows, weight=WEIGHT), "metrics")
    by_length = fp_by_length(rows, edges, weight=WEIGHT)
    by_keyword = fp_by_keyword(rows, weight=WEIGHT)
    comparison = metric_comparison(scored, variants)
    improvement = metric_improvement(scored, definitions, small, large)
    transitions = fp_transitions(profile, definitions, small, large, weight=WEIGHT)

    reports = {
        "metrics": scored,
        "metric_comparison": comparison,
        "metric_improvement": improvement,
        "fp_transitions": transitions,
        "fp_by_length": by_length.orderBy("definition", "model", "bin_ordinal"),
        "fp_length_curve": fp_length_curve(by_length, variants),
        "fp_keyword_topn": top_keywords(by_keyword),
        "dataset_overview": dataset_overview(profile, WEIGHT),
        "length_stats": length_stats(profile, WEIGHT),
        "length_histogram": length_histogram(profile, weight=WEIGHT),
        "length_cutoffs": best_length_cutoff(length_cutoff_curve(rows, weight=WEIGHT), cutoff_metric),
    }
    tables = {
        "fp_by_keyword": highest_rate_first(by_keyword, "keyword"),
        "keyword_counts": keyword_counts(profile, WEIGHT),
        "keyword_positive_rate": keyword_positive_rate(profile, weight=WEIGHT),
        "run_summary": run_summary(profile, variants, comparison, improvement, transitions, WEIGHT),
    }
    changes = fp_changes(wide, definitions, small, large, wide.columns)
    for category in ("fixed", "introduced"):
        tables[f"fp_{category}_rows"] = review_rows(changes, category, texts)
    if topics:
        fitted = fit_topics(fp_tokens(wide, variants, texts=texts), variants, topics)
        tables["topics"] = topic_counts(fitted)
        tables["topic_assignments"] = fitted.assignments
        tables["topic_examples"] = topic_examples(fitted, wide if texts is None else texts)

    for name, table in reports.items():
        write_report(table, f"{output}/{name}")
    for name, table in tables.items():
        write_table(table, f"{output}/{name}")
    return {**reports, **tables}
