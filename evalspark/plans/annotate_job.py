"""Annotate a table of items with one model, and report the decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.annotate import (
    ScorerFactory,
    annotation_table,
    decision_counts,
    observe_decisions,
    observed_counts,
)
from evalspark.operators.merge import binarize, long_answers
from evalspark.schemas import ITEMS, Rubric
from evalspark.sources.readers import limited, read_items
from evalspark.sources.writers import write_batch, write_report, write_table
from evalspark.streaming.incremental import annotate_incrementally, read_batches


def _report(annotations: DataFrame, rubrics: Sequence[Rubric], model: str, output: str) -> None:
    """Count the decisions in the written table, so that no answer is asked for twice."""
    definitions = [r.definition for r in rubrics]
    tagged = binarize(annotations, definitions).withColumn("model", F.lit(model))
    write_report(decision_counts(long_answers(tagged, definitions, ["item_id"])), f"{output}/decision_counts")


def annotate_table(
    spark: SparkSession,
    items_path: str,
    output: str,
    rubrics: Sequence[Rubric],
    model: str,
    scorer_factory: ScorerFactory,
    *,
    fmt: str = "csv",
    limit: int | None = None,
    **options,
) -> DataFrame:
    """Write ``annotations`` and ``decision_counts`` under ``output``; return the annotations."""
    items = limited(read_items(spark, items_path, fmt), limit)
    if limit and limit > 0 and options.get("parallelism") is None:
        # A limit leaves one partition, and one scorer.
        options["parallelism"] = min(limit, spark.sparkContext.defaultParallelism)
    definitions = [r.definition for r in rubrics]
    table, seen = observe_decisions(annotation_table(items, rubrics, scorer_factory, **options), definitions)
    write_table(table, f"{output}/annotations")
    write_report(observed_counts(spark, seen, definitions, model), f"{output}/decision_counts")
    return spark.read.parquet(f"{output}/annotations")


def annotate_folder(
    spark: SparkSession,
    items_path: str,
    output: str,
    rubrics: Sequence[Rubric],
    model: str,
    scorer_factory: ScorerFactory,
    *,
    files_per_batch: int = 100,
    **options,
) -> DataFrame:
    """Annotate the Parquet files of a folder in batches, each saved on its own.

    Run again after a stop, or after more files have come, it does only what is left.
    """
    stream = (
        spark.readStream.schema(ITEMS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(items_path)
    )

    def annotate_batch(batch: DataFrame, ingest_seq: int) -> DataFrame:
        return annotation_table(batch, rubrics, scorer_factory, ingest_seq=ingest_seq, **options)

    # An empty table first, so that a folder without items has annotations to read.
    write_batch(annotate_batch(spark.createDataFrame([], ITEMS), 0), f"{output}/annotations", -1)
    annotate_incrementally(
        stream, f"{output}/annotations", f"{output}/progress", annotate_batch
    ).awaitTermination()
    annotations = read_batches(spark, f"{output}/annotations")
    _report(annotations, rubrics, model, output)
    return annotations
