"""Batches of N rows under the names of their ranges."""

import shutil
from pathlib import Path

import pytest
from test_annotate import ITEMS, RUBRICS, _items, echo

from evalspark.operators.annotate import annotation_table, decision_counts
from evalspark.operators.merge import binarize, long_answers
from evalspark.streaming import row_ranges as rr

KEEP = ("item_id", "truth", "keyword", "text")


def annotator(calls, fail_at=None):
    def annotate(batch, first):
        if first == fail_at:
            raise RuntimeError("stopped")
        calls.append(first)
        return annotation_table(batch, RUBRICS, echo, keep=KEEP, ingest_seq=1)

    return annotate


def names(path):
    return sorted(x.name for x in Path(path).iterdir() if x.name.startswith("rows="))


def test_parts_counts_and_resume(spark, tmp_path):
    texts = [f"{'bad' if i % 3 else 'fine'} {i}" for i in range(95)]
    items = _items(spark, texts).repartition(3)
    rows = rr.number_rows(items, str(tmp_path / "numbered"))
    assert sorted(r["row"] for r in rows.collect()) == list(range(95))
    output, calls = str(tmp_path / "out"), []
    with pytest.raises(Exception, match="stopped"):
        rr.annotate_ranges(rows, output, ["A", "B"], 20, annotator(calls, fail_at=61))
    assert names(f"{output}/parts") == names(f"{output}/ledger") == [
        "rows=" + rr.range_name(a, a + 19) for a in (0, 20, 40)
    ]
    # A part that was cut off before the ledger had it, with half of its rows.
    cut = rows.where("row BETWEEN 60 AND 69").drop("row")
    annotation_table(cut, RUBRICS, echo, keep=KEEP).write.parquet(f"{output}/parts/rows={rr.range_name(60, 79)}")
    assert rr.read_parts(spark, output).count() == 60

    found = rr.annotate_ranges(rows, output, ["A", "B"], 20, annotator(calls))
    assert calls == [1, 21, 41, 61, 81], "each range once"
    assert names(f"{output}/parts")[-1] == "rows=" + rr.range_name(80, 94)
    assert sorted(r["item_id"] for r in found.collect()) == list(range(95))
    again = rr.annotate_ranges(rows, output, ["A", "B"], 20, annotator(calls))
    assert calls == [1, 21, 41, 61, 81] and again.count() == 95

    long = long_answers(binarize(again, ["A", "B"]).selectExpr("*", "'M' AS model"), ["A", "B"], ["item_id"])
    expected = decision_counts(long).drop("model").collect()
    totals = rr.decision_totals(spark, output).select(expected[0].__fields__)
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, expected))


def test_lost_checkpoint(spark, tmp_path):
    """Without its checkpoint, and with another size of batch, the stream goes on behind the ledger."""
    rows = rr.number_rows(_items(spark, ["bad"] * 30), str(tmp_path / "numbered"))
    output, calls = str(tmp_path / "out"), []
    with pytest.raises(Exception, match="stopped"):
        rr.annotate_ranges(rows, output, ["A"], 10, annotator(calls, fail_at=21))
    before = {p: p.stat().st_mtime_ns for p in Path(output, "parts").rglob("*.parquet")}
    shutil.move(f"{output}/progress", tmp_path / "lost")
    assert rr.annotate_ranges(rows, output, ["A"], 7, annotator(calls)).count() == 30
    assert calls == [1, 11, 21, 28]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert rr.rows_done(spark, output) == 30


def test_no_rows_and_numbers_once(spark, tmp_path):
    empty = spark.createDataFrame([], ITEMS)
    rows = rr.number_rows(empty, str(tmp_path / "numbered"))
    assert rr.rows_done(spark, str(tmp_path / "out")) == 0 and rows.count() == 0
    assert rr.annotate_ranges(rows, str(tmp_path / "out"), ["A"], 5, annotator([])).count() == 0
    # What is numbered stays as it is, though the items come in another order now.
    first = rr.number_rows(_items(spark, list("abc")), str(tmp_path / "n"))
    assert rr.number_rows(_items(spark, list("cba")), str(tmp_path / "n")).collect() == first.collect()
    with pytest.raises(ValueError, match="at least one"):
        rr.RowRanges({"total": "1", "size": "0", "done": "0"}).streamReader(None)


def test_one_range_reads_its_rows_only(spark, tmp_path):
    rows = rr.number_rows(_items(spark, ["x"] * 50), str(tmp_path / "numbered"))
    plan = rows.where("row BETWEEN 5 AND 9")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row,5), LessThanOrEqual(row,9)" in plan.replace("PushedFilters: [IsNotNull(row), ", "")
