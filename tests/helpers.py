"""Small tables for tests."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.schemas import Variant

A_S, A_L, B_S, B_L = (Variant(d, m) for d in "AB" for m in "SL")
VARIANTS = [A_S, A_L, B_S, B_L]
ROW = "definition string, model string, truth int, pred int"


def expand(spark: SparkSession, groups: list[tuple], schema: str) -> DataFrame:
    """Repeat each tuple of column values as often as its last element says."""
    df = spark.createDataFrame([g for g in groups if g[-1]], schema + ", times int")
    return df.select("*", F.explode(F.sequence(F.lit(1), "times")).alias("i")).drop("times", "i")


def cells(variant: Variant, tp: int, fp: int, fn: int, tn: int) -> list[tuple]:
    return [
        (variant.definition, variant.model, truth, pred, n)
        for truth, pred, n in ((1, 1, tp), (0, 1, fp), (1, 0, fn), (0, 0, tn))
    ]


def by(rows: list, *keys: str) -> dict:
    """Collected rows as a dict by one or several columns."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
