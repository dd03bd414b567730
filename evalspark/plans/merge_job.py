"""Merge the annotation tables of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.merge import combine_models, comparative
from evalspark.sources.readers import read_annotations
from evalspark.sources.writers import write_table


def merge_tables(
    spark: SparkSession,
    annotation_paths: dict[str, str],
    base_model: str,
    definitions: Sequence[str],
    output: str,
    fmt: str = "csv",
) -> tuple[DataFrame, DataFrame]:
    """Write and return ``combined`` (long by model) and ``comparative`` (one row per base row).

    The combined table is partitioned by model; the comparative table reads it back, so each input
    file is parsed once and each model's rows are found by partition.
    """
    combined = combine_models(
        {m: read_annotations(spark, path, definitions, fmt) for m, path in annotation_paths.items()},
        definitions,
    )
    write_table(combined, f"{output}/combined", partition_by=("model",))
    combined = spark.read.schema(combined.schema).parquet(f"{output}/combined")
    of_model = {m: combined.where(F.col("model") == m) for m in annotation_paths}
    wide = comparative(
        of_model[base_model],
        base_model,
        {m: df for m, df in of_model.items() if m != base_model},
        definitions,
    )
    write_table(wide, f"{output}/comparative")
    return combined, spark.read.schema(wide.schema).parquet(f"{output}/comparative")
