"""Failed answers of a stream are asked again in later micro-batches."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalspark.streaming import retries

SETTING = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, retries.PROVIDER)
    yield spark
    spark.conf.set(SETTING, before)


def scorer(log):
    """Fails once for each prompt with "once", always for those with "never"; what was asked is in a file."""

    def factory():
        def score(prompt):
            path = Path(log) / f"{prompt}.txt"
            n = path.read_text().count("x") if path.exists() else 0
            path.write_text("x" * (n + 1))
            if "never" in prompt or ("once" in prompt and n == 0):
                raise RuntimeError("busy")
            return f"DECISION: Yes EXPLANATION: {prompt}"

        return score

    return factory


def write(spark, path, rows):
    spark.createDataFrame(rows, retries.ANSWERS).coalesce(1).write.mode("append").parquet(str(path))


def test_failures_are_replaced(rocks, tmp_path):
    source, log, out = tmp_path / "in", tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    bad = "ERROR: Status code 500"
    write(rocks, source, [
        (1, "A", "fine 1", "DECISION: No", 10, 1), (2, "A", "passes 2", bad, 10, 1), (2, "B", "once 2", bad, 10, 1),
        (3, "A", "never 3", None, 10, 1), (4, "A", "spent 4", bad, 10, 3), (5, "A", None, bad, 10, 1),
    ])
    stream = rocks.readStream.schema(retries.ANSWERS).parquet(str(source))
    again = retries.ask_again(stream, scorer(str(log)), attempts=3, backoff=lambda n: 0.01)
    query = again.writeStream.format("parquet").option("checkpointLocation", f"{out}-progress").start(out)
    try:
        deadline = time.time() + 150
        while time.time() < deadline:
            assert query.exception() is None
            if Path(out).exists() and rocks.read.schema(retries.ANSWERS).parquet(out).count() >= 11:
                break
            time.sleep(1)
    finally:
        query.stop()
    answers = rocks.read.parquet(out)
    last = answers.groupBy("item_id", "definition").agg(F.max_by(F.struct("raw_response", "attempt"), "ingest_seq").alias("l"))
    got = {(r["item_id"], r["definition"]): tuple(r["l"]) for r in last.collect()}
    assert got == {
        (1, "A"): ("DECISION: No", 1),
        (2, "A"): ("DECISION: Yes EXPLANATION: passes 2", 2),
        (2, "B"): ("DECISION: Yes EXPLANATION: once 2", 3),
        (3, "A"): ("ERROR: busy", 3),
        (4, "A"): (bad, 3),
        (5, "A"): (bad, 1),
    }
    assert answers.count() == 11
    assert {p.stem for p in log.iterdir()} == {"passes 2", "once 2", "never 3"}


def test_needs_rocksdb(spark):
    stream = spark.readStream.format("rate").load().selectExpr(
        "value AS item_id", "'A' AS definition", "'p' AS prompt", "'r' AS raw_response", "value AS ingest_seq", "1 AS attempt"
    )
    with pytest.raises(ValueError, match="providerClass"):
        retries.ask_again(stream, lambda: str)
