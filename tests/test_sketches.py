"""Sketches, heavy hitters and range joins against the exact ways."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalspark.operators import sketches as sk
from evalspark.operators.range_join import HIGHEST, LOWEST, range_join


def lengths(spark, n=60_000):
    """A slice with a third of all rows, a small one, one of equal values, nulls."""
    source = F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 1000 == 1, "small").otherwise(
        F.concat(F.lit("s"), F.col("id") % 7)
    )
    rows = spark.range(n).select(source.alias("source"), (F.xxhash64("id") % 100_000).alias("text_length"), "id")
    equal = spark.range(500).select(F.lit("equal").alias("source"), F.lit(77).alias("text_length"), "id")
    none = spark.range(50).select(F.lit("none").alias("source"), F.lit(None).cast("long").alias("text_length"), "id")
    return rows.unionByName(equal).unionByName(none)


def test_quantiles_and_merged_parts(spark):
    items = lengths(spark)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    whole = sk.quantile_sketches(items, ["source"])
    days = sk.quantile_sketches(items.withColumn("day", F.col("id") % 9), ["source", "day"])
    for sketches in (whole, sk.merge_sketches(days, ["source"])):
        errors = sk.rank_errors(sk.sketch_quantiles(sketches, shares), items, ["source"]).collect()
        assert {r["source"] for r in errors} == {"big", "small", "equal", *(f"s{i}" for i in range(7))}
        assert len(errors) == 10 * len(shares) and all(r["rank_error"] <= sk.RANK_ERROR for r in errors)
    stats = {r["source"]: r for r in whole.collect()}
    merged = {r["source"]: r for r in sk.merge_sketches(days, ["source"]).collect()}
    for s, r in stats.items():
        assert [r[c] for c in ("n_items", "lowest", "highest")] == [merged[s][c] for c in ("n_items", "lowest", "highest")]
    everything = sk.sketch_quantiles(sk.merge_sketches(whole, []), [0.5])
    assert sk.rank_errors(everything, items, []).first()["rank_error"] <= sk.RANK_ERROR


def test_small_slices_are_exact(spark):
    items = spark.createDataFrame([(i % 2, i) for i in range(101)] + [(2, None)], "g int, text_length int")
    got = sk.sketch_quantiles(sk.quantile_sketches(items, ["g"]), [0.5, 1.0]).collect()
    assert {(r["g"], r["share"]): r["quantile"] for r in got} == {(0, 0.5): 50, (0, 1.0): 100, (1, 0.5): 49, (1, 1.0): 99}


def brute_top(values, n):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.mark.parametrize("tracked", [10, 200, 8192])
def test_top_values(spark, tracked):
    """Proved complete, or counted the exact way: few values, a flat tail of very many, ties at the end."""
    r = random.Random(4)
    skewed = [f"k{int(r.paretovariate(0.7))}" for _ in range(5000)] + [None] * 300
    flat = [f"f{i}" for i in range(3000)] + ["f5", "f1", None]
    few = ["a"] * 5 + ["b"] * 5 + ["c"]
    for values in (skewed, flat, few):
        df = spark.createDataFrame([(v, 1) for v in values], "keyword string, other int").repartition(4)
        got = [tuple(x) for x in sk.top_values(df, "keyword", 7, tracked).collect()]
        assert got == brute_top(values, 7), (tracked, values[:2])
    none = spark.createDataFrame([(None, 1)], "keyword string, other int")
    assert sk.top_values(none, "keyword", 7, tracked).collect() == []


def test_top_values_counts_candidates_only(spark):
    """A frequent head is proved: the values of the tail are not counted, and the result is a short list."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("hot"), F.col("id") % 6)).otherwise(F.concat(F.lit("t"), "id")).alias("k")
    )
    top = sk.top_values(df, "k", 3, 1000)
    assert [tuple(x) for x in top.collect()] == [("hot0", 5000), ("hot2", 5000), ("hot4", 5000)]
    assert "Aggregate" not in top._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        sk.top_values(df, "k", 11, 10)


def test_range_join(spark):
    """Ranges of all widths, overlapping, open, empty, per key; numbers at the ends, nulls, extremes, clashing names."""
    r = random.Random(6)
    ranges = [("a", i * 10, i * 10 + 10, f"n{i}") for i in range(300)]
    ranges += [("b", None, 50, "below"), ("b", 50, None, "above"), ("b", None, None, "all"), ("b", 5, 5, "empty"), ("b", 9, 3, "no")]
    ranges += [("c", lo := r.randint(-2000, 2000), lo + r.choice([1, 3, 64, 500, 4000]), f"r{i}") for i in range(80)]
    ranges += [("d", LOWEST, HIGHEST, "x"), ("d", HIGHEST, None, "none"), ("d", -1, 0, "zero"), (None, 0, 9, "null key")]
    numbers = [(k, r.choice([r.randint(-2500, 3100), 0, 10, 50, 51, 3000]), i) for i in range(400) for k in "abc"]
    numbers += [("d", v, 1) for v in (LOWEST, LOWEST + 1, 0, HIGHEST)] + [("a", None, 3), (None, 5, 4), ("z", 1, 5)]
    left = spark.createDataFrame(numbers, "k string, level long, cell int")
    right = spark.createDataFrame(ranges, "k string, low long, high long, name string")
    joined = range_join(left, right, "level", ["k"])
    assert joined.columns == ["k", "level", "cell", "low", "high", "name"]
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    got = sorted((x["k"], x["level"], x["cell"], x["name"]) for x in joined.collect())
    expected = sorted(
        (k, v, i, name)
        for k, v, i in numbers
        for own, lo, hi, name in ranges
        if k is not None and k == own and v is not None and (lo is None or v > lo) and (hi is None or v <= hi)
    )
    assert got == expected and len(got) > 2000
    assert range_join(left, right.limit(0), "level", ["k"]).collect() == []
    everywhere = range_join(left, right.drop("k"), "level").count()
    assert everywhere == sum(
        (lo is None or v > lo) and (hi is None or v <= hi) for _, v, _ in numbers if v is not None for _, lo, hi, _ in ranges
    )
