"""Reading items, annotations, comparative tables and rubrics."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.schemas import CSV_ITEM_COLUMNS, ITEMS, Rubric, Variant, annotations_schema
from evalspark.sources.split_csv import read_split_csv

# Texts hold line breaks and doubled quotes. A file read this way is one task; ``splittable`` reads it by many. A row with too few or too many fields stops
# the job, and so does a value that is no number in a column of numbers which the query reads.
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "escape": '"',
    "enforceSchema": "false",
    "mode": "FAILFAST",
    "columnPruning": "false",
}


def _csv_name(column: str) -> str:
    return next((c for c, ours in CSV_ITEM_COLUMNS.items() if ours == column), column)


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, splittable: bool = False) -> DataFrame:
    """The columns of ``schema``; from splittable CSV also ``position``, the order of the rows of all files."""
    if fmt != "csv":
        return spark.read.format(fmt).schema(schema).load(path)
    # Whole numbers in a column with gaps are often written as 1.0 and 0.0.
    kinds = {f.name: T.DoubleType() if f.dataType == T.IntegerType() else f.dataType for f in schema.fields}
    headed = T.StructType([T.StructField(_csv_name(n), kind) for n, kind in kinds.items()])
    if splittable:
        table = read_split_csv(spark, path, headed, CSV_OPTIONS).toDF("position", *schema.names)
    else:
        table = spark.read.schema(headed).options(**CSV_OPTIONS).csv(path).toDF(*schema.names)
    return table.withColumns({n: F.col(n).cast("int") for n, kind in kinds.items() if kind != schema[n].dataType})


def with_length(items: DataFrame) -> DataFrame:
    """Add the text length in code points."""
    return items.withColumn("text_length", F.length("text"))


def read_items(spark: SparkSession, path: str, fmt: str = "csv", splittable: bool = False) -> DataFrame:
    """Items; with ``splittable`` a CSV file is read by many tasks, in two passes (see ``split_csv``)."""
    return _read(spark, path, ITEMS, fmt, splittable).select(*ITEMS.names)


def limited(items: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` items by id, or all of them without a positive ``n``."""
    return items.orderBy("item_id").limit(n) if n and n > 0 else items


def read_annotations(
    spark: SparkSession, path: str, definitions: Sequence[str], fmt: str = "csv", splittable: bool = False
) -> DataFrame:
    """One model's annotation table, with ``ingest_seq`` telling later rows from earlier ones.

    Tables written by our own jobs carry that column, different in every row. In CSV files it follows the order of the rows.
    Spark gives no order between files; with ``splittable`` the files of a folder follow each other by time of change and
    name, so an id that is repeated across files has the same last row in every run.
    """
    schema = annotations_schema(list(definitions))
    position = F.monotonically_increasing_id()
    if fmt == "csv" and splittable:
        return _read(spark, path, schema, fmt, True).withColumnRenamed("position", "ingest_seq")
    if fmt == "csv":
        return _read(spark, path, schema, fmt).withColumn("ingest_seq", position)
    table = _read(spark, path, schema.add("ingest_seq", T.LongType()), fmt)
    return table.withColumn("ingest_seq", F.coalesce("ingest_seq", position))


def read_comparative(
    spark: SparkSession, path: str, variants: Sequence[Variant], fmt: str = "csv", splittable: bool = False
) -> DataFrame:
    """The wide table, with answers under the column names ``<definition>_Binary_<model>``.

    Answer columns that have gaps are written as 1.0 and 0.0, so all are read as double.
    """
    answers = {f"{v.definition}_Binary_{v.model}": v.name for v in variants}
    schema = T.StructType(list(ITEMS.fields))
    for column in [*answers, "text_length"]:
        schema = schema.add(column, T.DoubleType())
    table = _read(spark, path, schema, fmt, splittable).select(*schema.names).withColumnsRenamed(answers)
    return table.withColumns({c: F.col(c).cast("int") for c in [*answers.values(), "text_length"]})


def read_rubrics(spark: SparkSession, path: str) -> list[Rubric]:
    """One rubric per text file, named by the file: a template with one ``{text}`` field."""
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name").collect()
    return [
        Rubric.from_template(PurePosixPath(f.file_name).stem, f.value)
        for f in sorted(files, key=lambda f: f.file_name)
    ]
