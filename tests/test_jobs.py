"""The three jobs, one after the other, on small files."""

import pytest
from helpers import by

from evalspark.plans.analyze_job import analyze
from evalspark.plans.annotate_job import annotate_folder, annotate_table
from evalspark.plans.merge_job import merge_tables
from evalspark.schemas import ITEMS, Rubric, Variant
from evalspark.sources.writers import write_annotations, write_table

RUBRICS = [Rubric("A", "<", ">"), Rubric("B", "[", "]")]
VARIANTS = [Variant(d, m) for d in "AB" for m in "SL"]


def _items(spark, n=60):
    words = ["apples pears", "trains trams", "rivers lakes"]
    rows = [
        (i, "u", "2020", int(i % 5 == 0), f"k{i % 2}", f"{words[i % 3]} number {i}" + " pad" * (i % 40))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, ITEMS)


def _scorer(divisor):
    def factory():
        def score(prompt):
            number = int(prompt.split("number ")[1].split(" ")[0].strip("<>[]"))
            return f"DECISION: {'Yes' if number % divisor else 'No'} EXPLANATION: {number}"

        return score

    return factory


def test_jobs(spark, tmp_path):
    source = str(tmp_path / "items.csv")
    write_annotations(_items(spark), source)
    annotated = {}
    for model, divisor in (("S", 2), ("L", 3)):
        out = str(tmp_path / f"annotated-{model}")
        annotations = annotate_table(spark, source, out, RUBRICS, model, _scorer(divisor))
        assert annotations.count() == 60
        counts = by(
            spark.read.option("header", True).csv(f"{out}/decision_counts").collect(), "definition"
        )
        assert int(counts["A"].n_yes) == 60 - 60 // divisor
        annotated[model] = f"{out}/annotations"

    combined, comparative = merge_tables(spark, annotated, "S", ["A", "B"], str(tmp_path / "merged"), "parquet")
    assert combined.count() == 120 and comparative.count() == 60
    assert set(comparative.columns) == {*ITEMS.names, *[v.name for v in VARIANTS], "text_length"}

    results = analyze(comparative, VARIANTS, "S", "L", str(tmp_path / "results"), topics=2)
    metrics = by(results["metrics"].collect(), "definition", "model")
    assert metrics["A", "S"].fp == sum(i % 5 != 0 and i % 2 != 0 for i in range(60))
    assert metrics["B", "L"].fp == sum(i % 5 != 0 and i % 3 != 0 for i in range(60))
    changes = by(results["fp_transitions"].collect(), "category")
    assert changes["fixed"].A == results["fp_fixed_rows"].where("definition = 'A'").count()
    assert changes["introduced"].B == results["fp_introduced_rows"].where("definition = 'B'").count()
    assert changes["fixed"].A + changes["persistent"].A == metrics["A", "S"].fp
    by_length = results["fp_by_length"].where("definition = 'A' AND model = 'S'").collect()
    assert sum(r.n_fp for r in by_length) == metrics["A", "S"].fp
    overview = results["dataset_overview"].first()
    assert (overview.n_items, overview.n_positive) == (60, 12)
    summary = results["run_summary"].first()
    assert summary.variants == [v.name for v in VARIANTS]
    assert summary.comparison["recall"]["A_S"] == pytest.approx(metrics["A", "S"].recall)
    assert summary.fp_changes["fixed"]["B"] == changes["fixed"].B
    assert sum(r.n_texts for r in results["topics"].collect() if r.model == "S" and r.definition == "A") == (
        metrics["A", "S"].fp
    )
    for name in results:
        assert (tmp_path / "results" / name / "_SUCCESS").exists()


def test_analyze_with_separate_texts(spark, tmp_path):
    """The same results whether the text is a column of the wide table or a table of its own."""
    items = _items(spark).selectExpr(
        "*", "length(text) AS text_length", "int(item_id % 2) AS A_S", "int(item_id % 3 > 0) AS A_L"
    )
    variants = VARIANTS[:2]
    together = analyze(items, variants, "S", "L", str(tmp_path / "a"), topics=2)
    apart = analyze(
        items.drop("text"), variants, "S", "L", str(tmp_path / "b"), topics=2, texts=_items(spark)
    )
    assert set(together) == set(apart)
    for name in ("metrics", "fp_by_length", "fp_fixed_rows", "fp_introduced_rows", "length_histogram"):
        columns = together[name].columns
        rows = [sorted(map(str, t[name].select(columns).collect())) for t in (together, apart)]
        assert rows[0] == rows[1] and rows[0]


def test_a_later_batch_wins_in_the_merge(spark, tmp_path):
    """An item that comes again in a later file replaces its first answers."""
    annotated = {}
    for model in "SL":
        source, out = str(tmp_path / f"in-{model}"), str(tmp_path / f"out-{model}")
        for name, number in (("first", 2), ("second", 3)):
            if model == "L" or name == "first":
                again = spark.createDataFrame([(7, "u", "d", 0, "k", f"number {number}")], ITEMS)
                write_table(again, f"{source}/{name}")
            annotate_folder(spark, f"{source}/*", out, RUBRICS, model, _scorer(2), files_per_batch=1)
        annotated[model] = f"{out}/annotations"
    assert spark.read.parquet(annotated["L"]).count() == 2
    _, wide = merge_tables(spark, annotated, "S", ["A", "B"], str(tmp_path / "merged"), "parquet")
    row = wide.first()
    assert wide.count() == 1
    assert (row.A_S, row.B_S, row.A_L, row.B_L) == (0, 0, 1, 1)


def test_limit_of_items(spark, tmp_path):
    source = str(tmp_path / "items")
    write_table(_items(spark), source)
    out = str(tmp_path / "out")
    few = annotate_table(spark, source, out, RUBRICS, "S", _scorer(2), fmt="parquet", limit=4)
    assert sorted(r.item_id for r in few.collect()) == [0, 1, 2, 3]


def test_folder_job(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_table(_items(spark, 30).repartition(3), source)
    first = annotate_folder(spark, source, out, RUBRICS, "S", _scorer(2), files_per_batch=2)
    assert first.count() == 30 and first.select("batch_id").distinct().count() == 2
    assert annotate_folder(spark, source, out, RUBRICS, "S", _scorer(2)).count() == 30
