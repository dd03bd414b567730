"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evalspark.schemas import CSV_ITEM_COLUMNS, ITEMS

# Texts are written as they are: by default the CSV writer trims blanks.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write a table that grows with the data, as many files as it has partitions."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.format(fmt).save(path)


def write_annotations(df: DataFrame, path: str) -> None:
    """Write items or annotations as CSV under the headings that ``readers`` expects."""
    write_table(df.withColumnsRenamed({ours: c for c, ours in CSV_ITEM_COLUMNS.items()}), path, "csv")


def write_items(df: DataFrame, path: str) -> None:
    """Write the item columns as CSV under the headings that ``readers`` expects."""
    write_annotations(df.select(*ITEMS.names), path)


def write_report(df: DataFrame, path: str) -> None:
    """Write a result of a few rows as a single CSV file with a header."""
    write_table(df.coalesce(1), path, "csv")


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "item_id") -> None:
    """Save as a table bucketed by item, so that later joins and groupings by item need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    """Write one batch; writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")
