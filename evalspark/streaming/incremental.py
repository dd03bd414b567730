"""Annotation as files arrive, resumable after a stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from evalspark.sources.writers import write_batch


def annotate_incrementally(
    items: DataFrame,
    output: str,
    checkpoint: str,
    annotate_batch: Callable[[DataFrame, int], DataFrame],
) -> StreamingQuery:
    """Annotate all unseen rows of the stream ``items``, then stop.

    ``annotate_batch`` takes the rows of a micro-batch and its number from 1, which serves as
    ``ingest_seq``. The checkpoint remembers which files are done. Each micro-batch replaces its own
    folder, so a batch that is run again after a failure leaves no duplicates.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        write_batch(annotate_batch(batch, batch_id + 1), output, batch_id)

    return (
        items.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_batches(spark: SparkSession, output: str) -> DataFrame:
    """All annotated batches as one table."""
    return spark.read.parquet(output)
