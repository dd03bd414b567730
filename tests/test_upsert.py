"""Merging new answers into a merged table."""

import random

import pytest
from helpers import VARIANTS
from pyspark.sql import types as T

from evalspark.operators.merge import answers_by_item
from evalspark.operators.upsert import MergedAnswers

ITEM = T.StructType().add("item_id", "long").add("truth", "integer").add("keyword", "string")
ANSWERS = "item_id long, truth int, keyword string, definition string, model string, pred int, ingest_seq long"


def answers(r, n, start):
    ids = [r.randint(0, 60) if r.random() < 0.7 else 7 for _ in range(n)]
    rows = []
    for k, i in enumerate(ids):
        v = r.choice(VARIANTS)
        rows.append((i, i % 2, f"k{i % 3}", v.definition, v.model, r.choice([0, 1, None]), start + k))
    return rows


def table(spark, path, buckets=8):
    return MergedAnswers(spark, str(path), VARIANTS, buckets, ITEM)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_upserts_equal_one_merge(spark, tmp_path):
    """Batches in any order, an older answer after a newer one, a batch given twice, a hot item."""
    r = random.Random(3)
    batches = [answers(r, 80, 1000 * k) for k in range(4)]
    merged = table(spark, tmp_path / "m")
    for k in (1, 0, 3, 1, 2):
        merged.upsert(spark.createDataFrame(batches[k], ANSWERS))
    everything = spark.createDataFrame([x for b in batches for x in b], ANSWERS)
    whole = answers_by_item(everything, VARIANTS, ITEM.names)
    got = merged.read()
    assert got.columns == whole.columns
    assert content(got) == content(whole)
    # Another session's view of the same table.
    assert content(table(spark, tmp_path / "m").read()) == content(whole)


def test_touched_buckets_only(spark, tmp_path):
    merged = table(spark, tmp_path / "m", 16)
    first = spark.createDataFrame([(i, 1, "k", "A", "S", 1, i) for i in range(200)], ANSWERS)
    assert merged.upsert(first) == list(range(16))
    before = merged.current()
    new = spark.createDataFrame([(3, 1, "new", "A", "S", 0, 1000), (3, 1, "new", "B", "L", 1, 1001)], ANSWERS)
    [bucket] = merged.touched(new)
    read = merged.existing([bucket]).inputFiles()
    assert read and all(f"/bucket={bucket}/" in f for f in read)
    assert merged.upsert(new) == [bucket]
    after = merged.current()
    assert {b for b in after if after[b] != before[b]} == {bucket}
    rows = {x["item_id"]: x for x in merged.read().collect()}
    assert len(rows) == 200 and rows[3]["A_S"] == 0 and rows[3]["B_L"] == 1 and rows[3]["keyword"] == "new"
    assert rows[4]["A_S"] == 1 and rows[4]["B_L"] is None


def test_job_that_is_cut_off(spark, tmp_path, monkeypatch):
    """A job that dies before the log is written leaves the table as it was, and can be run again."""
    merged = table(spark, tmp_path / "m")
    merged.upsert(spark.createDataFrame([(i, 0, "k", "A", "S", 0, i) for i in range(50)], ANSWERS))
    before = content(merged.read())
    new = spark.createDataFrame([(i, 0, "k", "A", "S", 1, 100 + i) for i in range(50)], ANSWERS)
    create = spark.createDataFrame

    def dies(data, schema=None, *args, **kwargs):
        if schema is not None and "folder" in str(schema):
            raise RuntimeError("lost")
        return create(data, schema, *args, **kwargs)

    monkeypatch.setattr(spark, "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        merged.upsert(new)
    monkeypatch.undo()
    assert content(merged.read()) == before
    merged.upsert(new)
    assert {x["A_S"] for x in merged.read().collect()} == {1}


def test_odd_answers(spark, tmp_path):
    merged = table(spark, tmp_path / "m")
    assert merged.upsert(spark.createDataFrame([], ANSWERS)) == [] and merged.read().count() == 0
    odd = [(None, 1, "k", "A", "S", 1, 1), (1, 1, "k", "C", "S", 1, 1), (2, 1, "k", "A", "S", 1, None)]
    assert merged.upsert(spark.createDataFrame(odd, ANSWERS)) == []
    with pytest.raises(ValueError, match="other"):
        table(spark, tmp_path / "m", buckets=9)
