import csv
from types import SimpleNamespace

import pytest
from helpers import VARIANTS

from evalspark.schemas import ITEMS, Variant
from evalspark.session import materialize, scratch_path
from evalspark.sources import readers, writers

TEXTS = ['plain', ' two "quoted" words, and\na line\r\n ', "", None, "NA", "back\\slash \\", "😀,é", "null"]


def _items(spark):
    rows = [(10**17 + i, "u", "2020-01-01", i % 2, None if i == 1 else "k", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ITEMS)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_items_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / "items")
    items = _items(spark)
    writers.write_annotations(items, path) if fmt == "csv" else writers.write_table(items, path)
    back = readers.read_items(spark, path, fmt)
    assert back.schema == ITEMS
    expected = [None if fmt == "csv" and t == "" else t for t in TEXTS]  # an empty field is NULL
    rows = readers.with_length(back).orderBy("item_id").collect()
    assert [r.text for r in rows] == expected
    assert [r.text_length for r in rows] == [None if t is None else len(t) for t in expected]
    assert back.drop("text").exceptAll(items.drop("text")).isEmpty()


def test_csv_written_by_others(spark, tmp_path):
    """A file as Python's csv module writes it, gaps in an answer column making it 1.0 and 0.0."""
    path = tmp_path / "wide.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(
            ["TweetID", "Username", "CreateDate", "Biased", "Keyword", "Text"]
            + ["A_Binary_S", "B_Binary_S", "A_Binary_L", "B_Binary_L", "text_length"]
        )
        out.writerow([5, "u", "d", 1, "k", 'a "b"\nc', 1, 0, "1.0", "0.0", 7])
        out.writerow([6, "u", "d", 0, "", "x", 0, 0, "", "", 1])
    variants = [Variant(d, m) for m in "SL" for d in "AB"]
    rows = readers.read_comparative(spark, str(path), variants).orderBy("item_id").collect()
    assert [(r.text, r.keyword, r.A_S, r.A_L, r.B_L, r.text_length) for r in rows] == [
        ('a "b"\nc', "k", 1, 1, 0, 7),
        ("x", None, 0, None, None, 1),
    ]


def test_annotations_keep_the_order_of_rows(spark, tmp_path):
    path = tmp_path / "annotations.csv"
    head = "TweetID,Username,CreateDate,Biased,Keyword,Text,A_Decision,A_Explanation"
    path.write_text(head + "\n" + "".join(f"1,u,d,0,k,t,{d},e\n" for d in ("Yes", "No", "Unclear")))
    rows = readers.read_annotations(spark, str(path), ["A"]).orderBy("ingest_seq").collect()
    assert [r.A_Decision for r in rows] == ["Yes", "No", "Unclear"]


def test_limit(spark):
    items = _items(spark)
    assert [r.item_id - 10**17 for r in readers.limited(items, 3).collect()] == [0, 1, 2]
    assert readers.limited(items, 0).count() == readers.limited(items, None).count() == len(TEXTS)


def test_rubrics(spark, tmp_path):
    (tmp_path / "B.txt").write_text('Rule B\n"{text}"\n')
    (tmp_path / "A.txt").write_text("Rule A {{x}} {text}")
    rubrics = readers.read_rubrics(spark, str(tmp_path))
    assert [tuple(r) for r in rubrics] == [("A", "Rule A {x} ", ""), ("B", 'Rule B\n"', '"\n')]


def test_report_is_one_file(spark, tmp_path):
    writers.write_report(spark.range(100).repartition(5), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("*.csv"))) == 1


def test_batch_is_replaced(spark, tmp_path):
    for n in (5, 3):
        writers.write_batch(spark.range(n), str(tmp_path), 0)
    writers.write_batch(spark.range(2), str(tmp_path), 1)
    assert spark.read.parquet(str(tmp_path)).count() == 5


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left_answers", "right_answers"):
            writers.write_bucketed(spark.range(50).withColumnRenamed("id", "item_id"), name, 4)
        joined = spark.table("left_answers").join(spark.table("right_answers"), "item_id")
        assert joined.count() == 50
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("left_answers", "right_answers"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _fake_session(setting, master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
    return SimpleNamespace(conf={"spark.checkpoint.dir": setting}, sparkContext=context)


def test_scratch_follows_the_setting(spark):
    assert scratch_path(_fake_session("hdfs://x/y/", "yarn"), "t").startswith("hdfs://x/y/evalspark/t-")
    assert scratch_path(_fake_session(None, "yarn", "s3://c"), "t").startswith("s3://c/evalspark/t-")
    with pytest.raises(ValueError):
        scratch_path(_fake_session(None, "yarn"), "t")
    table = materialize(spark.range(3), "numbers")
    assert table.count() == 3 and "/evalspark/numbers-" in table.inputFiles()[0]


def test_variant_names():
    assert [v.name for v in VARIANTS] == ["A_S", "A_L", "B_S", "B_L"]


def test_labels_with_gaps(spark, tmp_path):
    """A label column as 1, 1.0 and nothing."""
    path = tmp_path / "items.csv"
    head = "TweetID,Username,CreateDate,Biased,Keyword,Text\n"
    path.write_text(head + "1,u,d,1.0,k,a\n2,u,d,0,k,b\n3,u,d,,k,c\n")
    rows = readers.read_items(spark, str(path)).orderBy("item_id").collect()
    assert [r.truth for r in rows] == [1, 0, None]


@pytest.mark.parametrize("row", ["x1,u,d,1,k,a", "1,u,d,1", "1,u,d,1,k,a,more", "1,u,d,maybe,k,a"])
def test_rows_that_do_not_fit_fail(spark, tmp_path, row):
    path = tmp_path / "items.csv"
    path.write_text(f"TweetID,Username,CreateDate,Biased,Keyword,Text\n{row}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_items(spark, str(path)).collect()
