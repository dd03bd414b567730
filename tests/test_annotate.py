import pytest
from helpers import by

import __spark_entry__ as entry
from evalspark.operators.annotate import (
    annotate,
    annotation_table,
    ask,
    build_prompts,
    decision_counts,
    fan_out,
    linear_backoff,
)
from evalspark.schemas import Rubric
from evalspark.sources import derived
from evalspark.streaming.incremental import annotate_incrementally, read_batches

RUBRICS = [Rubric("A", "<", ">"), Rubric("B", "[{x} ", "]")]
ITEMS = "item_id long, truth int, keyword string, text string, text_length int"


def _items(spark, texts, start=0):
    rows = [(start + i, None if i % 2 else 1, "k", t, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ITEMS)


def echo():
    return lambda prompt: f"DECISION: {'Yes' if 'bad' in prompt else 'No'} EXPLANATION: {prompt}"


def test_rubric_templates():
    assert Rubric.from_template("A", 'a {{b}} "{text}" c') == Rubric("A", 'a {b} "', '" c')
    assert Rubric.from_template("A", "{text}") == Rubric("A", "", "")
    for wrong in ("no field", "{text} {text}", "{other}"):
        with pytest.raises(ValueError):
            Rubric.from_template("A", wrong)


def test_prompts_keep_braces(spark):
    prompts = build_prompts(fan_out(_items(spark, ["{text} {0}", "x"]), RUBRICS)).collect()
    found = {(r.item_id, r.definition): r.prompt for r in prompts}
    assert found == {
        (0, "A"): "<{text} {0}>",
        (0, "B"): "[{x} {text} {0}]",
        (1, "A"): "<x>",
        (1, "B"): "[{x} x]",
    }


def test_retry():
    calls, waits = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return "done"

    assert ask(flaky, "p", 3, linear_backoff, waits.append) == "done"
    assert waits == [2.0, 4.0]
    calls.clear()
    assert ask(flaky, "p", 2, linear_backoff, waits.append) == "ERROR: busy"
    assert waits == [2.0, 4.0, 2.0]


def test_annotate_isolates_failures(spark):
    def scorer():
        def score(prompt):
            if "boom" in prompt:
                raise RuntimeError("Status code 500")
            return 7 if "number" in prompt and prompt[0] == "<" else echo()(prompt)

        return score

    items = _items(spark, ["bad", "good", "boom", "number", None])
    scored = annotate(items, RUBRICS, "M", scorer, sleep=lambda s: None, parallelism=3)
    rows = by(scored.collect(), "item_id", "definition")
    assert (rows[0, "A"].decision, rows[0, "A"].pred, rows[0, "A"].truth) == ("Yes", 1, 1)
    assert (rows[1, "B"].decision, rows[1, "B"].explanation) == ("No", "[{x} good]")
    assert rows[1, "B"].truth is None
    assert (rows[2, "A"].raw_response, rows[2, "A"].decision) == ("ERROR: Status code 500", "Unclear")
    assert (rows[3, "A"].decision, rows[3, "A"].explanation) == ("Error", "scorer returned int, not text")
    assert rows[3, "B"].decision == "No"
    assert (rows[4, "A"].decision, rows[4, "A"].explanation) == ("Error", "no text")
    counts = by(decision_counts(scored).collect(), "definition")
    assert tuple(counts["A"])[2:] == (5, 1, 1, 1, 2)


def test_annotation_table_equals_long_predictions(spark):
    items = _items(spark, ["bad", "good", None]).selectExpr("*", "'u' AS author", "'d' AS created")
    wide = by(annotation_table(items, RUBRICS, echo, ingest_seq=4).collect(), "item_id")
    assert {r.ingest_seq >> 44 for r in wide.values()} == {4}
    assert len({r.ingest_seq for r in wide.values()}) == len(wide), "no two rows tie"
    for r in annotate(items, RUBRICS, "M", echo).collect():
        row = wide[r.item_id]
        assert (row[f"{r.definition}_Decision"], row[f"{r.definition}_Explanation"]) == (
            r.decision,
            r.explanation,
        )
    plan = annotation_table(items, RUBRICS, echo)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_incremental_equals_batch_and_resumes(spark, tmp_path):
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    everything = [[f"bad {i}" for i in range(4)], ["good", "bad"], ["x" * 20, "{}"]]
    columns = ["item_id", "definition", "model", "raw_response", "decision", "explanation", "pred"]

    def run():
        stream = (
            spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        )
        query = annotate_incrementally(
            stream,
            output,
            progress,
            lambda batch, seq: annotate(batch, RUBRICS, "M", echo, ingest_seq=seq),
        )
        query.awaitTermination()
        return read_batches(spark, output)

    for n, texts in enumerate(everything):
        _items(spark, texts, 100 * n).coalesce(1).write.parquet(f"{source}/{n}")
        if n != 0:
            found = run()
    assert found.select("batch_id").distinct().count() == 3
    again = run()
    batch = annotate(spark.read.schema(ITEMS).parquet(f"{source}/*"), RUBRICS, "M", echo)
    expected = sorted(map(tuple, batch.select(columns).collect()))
    assert sorted(map(tuple, again.select(columns).collect())) == expected
    assert len(expected) == 16


@pytest.mark.parametrize("files", [0, 1, 3])
def test_documents_stream_as_a_file_or_a_folder(spark, tmp_path, files):
    """0 files: the table is a single file, not a folder."""
    rows = [(i, f"text {i}", "en", "src1", 6) for i in range(12)]
    docs = spark.createDataFrame(rows, derived.DOCUMENTS).repartition(files or 1)
    docs.write.parquet(str(tmp_path / ("documents.parquet" if files else "rows")))
    if not files:
        (part,) = (tmp_path / "rows").glob("part-*.parquet")
        (tmp_path / "documents.parquet").write_bytes(part.read_bytes())
    spark.createDataFrame([(3, 1, 0)], derived.LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    found = entry.annotate_incremental(spark, str(tmp_path))
    batch = entry.annotate(spark, str(tmp_path))
    columns = ["item_id", "definition", "raw_response", "truth", "decision"]
    assert found.count() == 24
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
