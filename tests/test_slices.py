import pytest
from helpers import A_S, ROW, expand
from pyspark.sql import functions as F

from evalspark.functions.bins import LENGTH_EDGES, bin_labels
from evalspark.operators import dataset, slices


def test_labels():
    assert bin_labels(LENGTH_EDGES)[:2] == ["0-80", "81-120"]
    assert bin_labels(LENGTH_EDGES)[-2:] == ["401-600", "601+"]


@pytest.mark.parametrize(("open_ended", "outer"), [(False, (None, None)), (True, ("0-80", "601+"))])
def test_bins(spark, open_ended, outer):
    lengths = {0: outer[0], 1: "0-80", 80: "0-80", 81: "81-120", 600: "401-600", 601: "601+"}
    lengths |= {1000: "601+", 1001: outer[1], None: None}
    df = spark.createDataFrame([(n,) for n in lengths], "text_length int")
    found = slices.length_bins(df, open_ended=open_ended).collect()
    assert {r.text_length: r.length_bin for r in found} == lengths


def _row(keyword, truth, pred, n):
    return (*A_S, truth, pred, keyword, n)


def test_keywords(spark):
    groups = [
        _row("four", 0, 1, 4),
        _row("five", 0, 1, 5),
        _row("positive", 1, 1, 9),
        _row(None, 0, 1, 9),
        _row("case", 0, 1, 5),
        _row("Case", 0, 0, 5),
        _row("tie", 0, 1, 3),
        _row("tie", 1, 0, 3),
    ]
    rows = expand(spark, groups, ROW + ", keyword string")
    found = slices.highest_rate_first(slices.fp_by_keyword(rows), "keyword").collect()
    assert [(r.keyword, r.n_items, r.n_negative, r.n_fp) for r in found] == [
        ("case", 5, 5, 5),
        ("five", 5, 5, 5),
        ("tie", 6, 3, 3),
        ("Case", 5, 5, 0),
    ]
    listed = slices.filter_keywords(rows, ["five", "case"])
    table = spark.createDataFrame([("five",), ("case",)], "keyword string")
    assert listed.count() == slices.filter_keywords(rows, table).count() == 10


def test_dataset_statistics(spark):
    items = spark.createDataFrame(
        [(1, "a", 10), (0, "a", 20), (0, "b", 30), (None, None, 41), (1, "a", None)],
        "truth int, keyword string, text_length int",
    )
    overview = dataset.dataset_overview(items).first()
    assert tuple(overview) == (5, 4, 2, 2, 0.5)
    assert [tuple(r) for r in dataset.keyword_counts(items).collect()] == [("a", 3), ("b", 1)]
    rates = dataset.keyword_positive_rate(items, 3).collect()
    assert [(r.keyword, r.n_items) for r in rates] == [("a", 3)]
    assert rates[0].positive_rate == pytest.approx(2 / 3)
    stats = dataset.length_stats(items).first()
    assert (stats.n_items, stats.mean_length, stats.median_length) == (4, 25.25, 25.0)


@pytest.mark.parametrize("lengths", [[5], [7, 7, 7], [0, 19, 20], list(range(101)), [1, 2, 1000, 1000]])
def test_histogram(spark, lengths):
    np = pytest.importorskip("numpy")
    df = spark.createDataFrame([(n,) for n in lengths], "text_length int")
    found = dataset.length_histogram(df, 20).orderBy("bin").collect()
    counts, edges = np.histogram(lengths, 20)
    assert [r.n_items for r in found] == counts.tolist()
    assert [r.lower for r in found] == pytest.approx(edges[:-1].tolist())
    assert [r.upper for r in found] == pytest.approx(edges[1:].tolist())


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "truth int, keyword string, text_length int")
    assert dataset.dataset_overview(empty).first().positive_share is None
    assert dataset.length_stats(empty).first().mean_length is None
    assert dataset.length_histogram(empty).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_partitioning_does_not_matter(spark, partitions):
    rows = spark.range(2000).select(
        F.lit("A").alias("definition"),
        F.lit("S").alias("model"),
        (F.col("id") % 2).cast("int").alias("truth"),
        (F.col("id") % 3 == 0).cast("int").alias("pred"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("keyword"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    reference = sorted(map(tuple, slices.fp_by_keyword(rows).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        again = slices.fp_by_keyword(rows.repartition(partitions)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, again)) == reference
