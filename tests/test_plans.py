"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry
from evalspark.operators import topics
from evalspark.sources import derived

SF_DIR = "/root/testdata/sf0.001"
NARROW = [
    "classification_metrics",
    "confusion_matrix",
    "metrics_by_slice",
    "fp_by_length",
    "fp_by_keyword",
    "fp_transitions",
    "dedup_last_wins",
    "dataset_overview",
    "keyword_counts",
    "length_histogram",
    "length_stats",
    "unscored_items",
    "definition_fanout",
]
OPTIONAL = {n for m in entry.OPTIONAL for n in m.queries()}
# Queries that write and read back what they are about.
EAGER = ("run_summary_tables", "annotate_ranges", "merge_upsert", "keyword_topn_summary")
LAZY = [
    n
    for n in entry.queries()
    if n not in ("scan_annotations", "annotate_incremental", "run_summary", *EAGER, *OPTIONAL) and "topic" not in n
]
# Scorers, and the reader that cuts records.
PYTHON = ("annotate", "annotate_concurrent", "scan_items_split")


def _plan(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_python_only_in_scoring(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("InArrow" in plan) == (name in PYTHON)
    assert "EvalPython" not in plan and "ExternalRDD" not in plan


@pytest.mark.parametrize("name", NARROW)
def test_text_is_not_read(spark, name):
    plan = _plan(spark, name)
    schemas = re.findall(r"ReadSchema: (\S+)", plan)
    assert schemas and not any(re.search(r"[<,]text:", s) for s in schemas)


def test_last_answers_are_hash_aggregated_in_one_shuffle(spark):
    plan = _plan(spark, "unpivot_predictions")
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "Window" not in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_labels_prune_documents_by_an_inner_join(spark):
    plan = _plan(spark, "classification_metrics")
    assert "LeftOuter" not in plan and "Inner" in plan
    assert "IsNotNull(toxic)" in plan


def test_top_keywords_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(spark, "fp_keyword_topn")
    assert "Sort [definition" in _plan(spark, "fp_keyword_topn")


def test_limits_avoid_a_full_sort(spark):
    for name in ("limited_scan", "keyword_topn", "keyword_positive_rate"):
        assert "TakeOrderedAndProject" in _plan(spark, name)


def test_topic_examples_are_chosen_before_texts_are_fetched(spark):
    texts = spark.read.schema(derived.DOCUMENTS).parquet(f"{SF_DIR}/documents.parquet")
    assigned = texts.selectExpr(
        "'A' AS definition", "'S' AS model", "doc_id AS item_id", "doc_id AS text_no",
        "xxhash64(text) AS text_key", "int(doc_id % 3) AS topic",
    )
    tables = topics.TopicTables(None, assigned)
    examples = topics.topic_examples(tables, texts.withColumnRenamed("doc_id", "item_id"))
    plan = examples._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert examples.count() == 15
