from helpers import A_L, A_S, B_L, B_S, VARIANTS, by
from pyspark.sql import functions as F

from evalspark.operators import merge
from evalspark.schemas import Variant

S2 = (
    "item_id long, author string, created string, truth int, keyword string, text string, "
    "A_Decision string, B_Decision string, ingest_seq long"
)


def _annotations(spark, rows):
    return spark.createDataFrame(
        [(i, "u", "d", 0, "k", f"text {i}", a, b, seq) for i, a, b, seq in rows], S2
    )


def _binary(spark, model, rows):
    return merge.binarize(_annotations(spark, rows), ["A", "B"]).withColumn("model", F.lit(model))


def test_binarize(spark):
    rows = [(i, d, None, 1) for i, d in enumerate(["Yes", "No", "Unclear", "Error", "yes"])]
    found = _binary(spark, "S", rows).orderBy("item_id").collect()
    assert [r.A_Binary for r in found] == [1, 0, 0, 0, 0]
    assert {r.B_Binary for r in found} == {0}


def test_comparative(spark):
    small = _binary(
        spark, "S", [(1, "Yes", "No", 1), (2, "No", "No", 2), (2, "Yes", "Yes", 3), (3, "No", "Yes", 4)]
    )
    large = _binary(
        spark, "L", [(1, "No", "Yes", 1), (1, "Yes", "No", 2), (2, "Unclear", "Yes", 3), (9, "Yes", "Yes", 4)]
    )
    wide = merge.comparative(small, "S", {"L": large}, ["A", "B"])
    answers = wide.select("item_id", *[v.name for v in (A_S, B_S, A_L, B_L)])
    found = sorted(tuple(r) for r in answers.where("item_id < 3").collect())
    assert found == [(1, 1, 0, 1, 0), (2, 0, 0, 0, 1), (2, 1, 1, 0, 1)]
    assert [tuple(r) for r in answers.where("item_id >= 3").collect()] == [(3, 0, 1, None, None)]
    assert {r.item_id: r.text_length for r in wide.collect()} == {1: 6, 2: 6, 3: 6}


def test_comparative_splits_a_hot_item(spark):
    """Where one id holds most of the base rows, adaptive execution splits its join partition."""
    rows = spark.range(60000)
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    base = rows.select(
        hot.alias("item_id"),
        *[F.lit("x").alias(c) for c in ("author", "created", "keyword")],
        F.lit(0).alias("truth"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text"),
        *[F.lit(1).alias(f"{d}_Binary") for d in "AB"],
    )
    other = rows.select(
        F.col("id").alias("item_id"),
        F.lit("L").alias("model"),
        F.lit(1).cast("long").alias("ingest_seq"),
        *[(F.col("id") % 2).cast("int").alias(f"{d}_Binary") for d in "AB"],
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        wide = merge.comparative(base, "S", {"L": other}, ["A", "B"])
        assert wide.where("item_id = 7 AND A_L = 1").count() == 20001
        assert wide.count() == 60000
        wide.collect()
        assert "skew=true" in wide._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in conf:
            spark.conf.unset(key)


def test_last_answer_and_evaluation_rows(spark):
    answers = spark.createDataFrame(
        [
            (1, 0, "k", 5, "A", "S", 1, 1, 1),
            (1, 0, "k", 5, "A", "S", 2, 0, 2),
            (1, 0, "k", 5, "B", "L", 1, 1, 1),
            (2, 1, None, None, "A", "L", 1, 3, 0),
        ],
        "item_id long, truth int, keyword string, text_length int, definition string, model string, "
        "ingest_seq long, decision_code int, pred int",
    ).withColumn("pred", (F.col("decision_code") == 1).cast("int"))
    last = merge.last_answer(answers, ["item_id", "definition", "model"], ["pred", "decision_code"])
    assert by(last.collect(), "item_id", "definition", "model")[1, "A", "S"].pred == 0
    rows = by(merge.evaluation_rows(answers, VARIANTS).collect(), "item_id", "definition", "model")
    assert len(rows) == 8
    assert (rows[1, "A", "S"].decision, rows[1, "A", "S"].pred) == ("No", 0)
    assert (rows[2, "A", "L"].decision, rows[2, "A", "L"].pred) == ("Error", 0)
    assert rows[2, "A", "S"].pred is None and rows[2, "A", "S"].decision is None


def test_round_trip_and_selection(spark):
    wide = spark.createDataFrame([(1, 0, 1, None, 0), (2, 1, 0, 1, None)], "item_id long, A_S int, A_L int, B_S int, B_L int")
    long = merge.unpivot_predictions(wide, VARIANTS, ["item_id"])
    assert long.count() == 8
    back = merge.answers_by_item(long.withColumn("ingest_seq", F.lit(1)), VARIANTS, ["item_id"])
    assert sorted(back.collect()) == sorted(wide.select(back.columns).collect())
    assert {r.model for r in merge.select_models(long, ["L"]).collect()} == {"L"}


def test_unscored(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    answers = spark.createDataFrame(
        [(1, "A", "S"), (1, "A", "L"), (1, "B", "S"), (1, "B", "L"), (2, "A", "S"), (2, "B", "L")],
        "item_id long, definition string, model string",
    )
    found = {tuple(r) for r in merge.unscored_items(items, answers, VARIANTS).collect()}
    assert found == {(2, *A_L), (2, *B_S), (3, *A_S), (3, *A_L), (3, *B_S), (3, *B_L)}


def test_combine_and_long(spark):
    tables = {"S": _annotations(spark, [(1, "Yes", "No", 1)]), "L": _annotations(spark, [(1, "No", "Error", 1)])}
    combined = merge.combine_models(tables, ["A", "B"])
    long = merge.long_answers(combined, ["A", "B"], ["item_id"])
    assert {(r.model, r.definition, r.decision, r.pred) for r in long.collect()} == {
        ("S", "A", "Yes", 1),
        ("S", "B", "No", 0),
        ("L", "A", "No", 0),
        ("L", "B", "Error", 0),
    }


def test_unscored_with_many_variants(spark):
    """More variants than a number has bits."""
    variants = [Variant(f"D{i}", "M") for i in range(130)]
    answers = [(item, v.definition, "M") for item in (1, 2) for i, v in enumerate(variants) if (i + item) % 3]
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    found = merge.unscored_items(items, spark.createDataFrame(answers, "item_id long, definition string, model string"), variants)
    expected = {(item, v.definition) for item in (1, 2, 3) for v in variants} - {a[:2] for a in answers}
    assert {(r.item_id, r.definition) for r in found.collect()} == expected
