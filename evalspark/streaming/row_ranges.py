"""Annotation in batches of N rows, each saved under its row range, resumable after a stop.

The items are numbered once, as a stored table sorted by number, so a range of rows is read by its row groups. A
stream hands out ranges: its offset is the number of rows handed out, so the checkpoint says which range is under way. A batch
writes its part under the range's name and then one row, with the counts of the decisions, into a ledger. A range is done
once the ledger has it: a batch that was cut off replaces its part; a stream that has lost its checkpoint goes on where the
ledger ends. Totals are sums over the ledger, whose counts are observed while a part is written, so no answer is
read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from evalspark.operators.annotate import observe_decisions
from evalspark.schemas import DECISIONS
from evalspark.session import ship_package

RANGES = "first bigint, last bigint"


def number_rows(items: DataFrame, path: str) -> DataFrame:
    """``items`` with ``row`` = 0, 1, 2, ..., stored under ``path``; a table that is there already is read as it is.

    Rows keep their order in each input partition, and partitions their order, so numbers follow the files.
    """
    spark = items.sparkSession
    if not _exists(spark, f"{path}/rows/_SUCCESS"):
        own = F.monotonically_increasing_id()
        parts = items.select("*", F.shiftright(own, 33).alias("part"), own.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
        # Stored first, as numbers of rows hold only for partitions that do not change.
        parts.write.mode("overwrite").parquet(f"{path}/parts")
        parts = spark.read.schema(parts.schema).parquet(f"{path}/parts")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
        # One row per partition of the input.
        starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        rows = parts.join(F.broadcast(starts), "part").withColumn("row", F.col("start") + F.col("at"))
        rows.drop("part", "at", "start").sortWithinPartitions("row").write.mode("overwrite").parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _RangeReader(DataSourceStreamReader):
    """Offsets are numbers of rows handed out, ``size`` more at each trigger."""

    def __init__(self, total: int, size: int, done: int):
        self.total, self.size, self.done = total, size, done

    def initialOffset(self) -> dict:
        return {"rows": self.done}

    def latestOffset(self) -> dict:
        return {"rows": min(self.done + self.size, self.total)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # Also called for a batch of the checkpoint that was cut off, before any new offset is asked for.
        self.done = max(self.done, end["rows"])
        return [_Range(start["rows"], end["rows"] - 1)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition.last >= partition.first:
            yield partition.first, partition.last

    def commit(self, end: dict) -> None:
        self.done = max(self.done, end["rows"])


class RowRanges(DataSource):
    """A stream of row ranges (``first``, ``last``): options ``total``, ``size`` and ``done``, the rows done already."""

    @classmethod
    def name(cls) -> str:
        return "row_ranges"

    def schema(self) -> str:
        return RANGES

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        total, size, done = (int(self.options[o]) for o in ("total", "size", "done"))
        if size < 1:
            raise ValueError("a batch must have at least one row")
        return _RangeReader(total, size, done)


def range_name(first: int, last: int) -> str:
    """Twelve digits, so that names sort as the ranges do."""
    return f"{first:012d}-{last:012d}"


def _save(batch: DataFrame, definitions: Sequence[str], output: str, first: int, last: int) -> None:
    """Write the part, then its row of the ledger."""
    spark, name = batch.sparkSession, range_name(first, last)
    observed, seen = observe_decisions(batch, definitions)
    observed.write.mode("overwrite").parquet(f"{output}/parts/rows={name}")
    counts = seen.get
    row = [(first, last, counts["n_rows"], [(k, n) for k, n in sorted(counts.items()) if k != "n_rows"])]
    kinds = "first long, last long, n_rows long, counts array<struct<name:string,n:long>>"
    ledger = spark.createDataFrame(row, kinds).coalesce(1)
    ledger.write.mode("overwrite").parquet(f"{output}/ledger/rows={name}")


def read_ledger(spark: SparkSession, output: str) -> DataFrame:
    """One row per finished range: ``first``, ``last``, ``n_rows`` and ``counts``."""
    kinds = "first long, last long, n_rows long, counts array<struct<name:string,n:long>>, rows string"
    if not _exists(spark, f"{output}/ledger"):
        return spark.createDataFrame([], kinds).drop("rows")
    return spark.read.schema(kinds).parquet(f"{output}/ledger").drop("rows")


def rows_done(spark: SparkSession, output: str) -> int:
    """The number of rows up to the first gap of the ledger."""
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    ledger = read_ledger(spark, output).select("first", "last")
    gaps = ledger.withColumn("due", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))
    gap = gaps.where("first > due").agg(F.min("due")).first()[0]
    if gap is not None:
        return gap
    return (ledger.agg(F.max("last")).first()[0] or -1) + 1


def decision_totals(spark: SparkSession, output: str) -> DataFrame:
    """How often each decision was given per definition: sums over the ledger."""
    named = read_ledger(spark, output).select(F.inline("counts")).select(
        F.substring_index("name", "|", 1).alias("definition"), F.substring_index("name", "|", -1).alias("decision"), "n"
    )
    return named.groupBy("definition").agg(
        F.sum("n").alias("n_answers"),
        *[F.sum(F.when(F.col("decision") == d, F.col("n")).otherwise(0)).alias(f"n_{d.lower()}") for d in DECISIONS],
    )


def annotate_ranges(
    rows: DataFrame,
    output: str,
    definitions: Sequence[str],
    rows_per_batch: int,
    annotate_batch: Callable[[DataFrame, int], DataFrame],
) -> DataFrame:
    """Annotate numbered ``rows`` (from ``number_rows``) in ranges of ``rows_per_batch`` and return all parts as one table.

    ``annotate_batch`` takes the rows of a range and the number of its first one from 1, which serves as ``ingest_seq``, and
    returns a column ``<definition>_Decision`` per definition. Run again after a stop it does what is left.
    """
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(RowRanges)
    total = rows.count()
    if not total:
        return annotate_batch(rows.drop("row"), 1)
    options = {"total": str(total), "size": str(rows_per_batch), "done": str(rows_done(spark, output))}

    def run(ranges: DataFrame, _: int) -> None:
        # One range per batch.
        for first, last in ranges.collect():
            batch = rows.where(F.col("row").between(first, last)).drop("row")
            _save(annotate_batch(batch, first + 1), definitions, output, first, last)

    stream = spark.readStream.format(RowRanges.name()).options(**options).load()
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{output}/progress").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return read_parts(spark, output)


def read_parts(spark: SparkSession, output: str) -> DataFrame:
    """The annotations of all finished ranges."""
    parts = spark.read.parquet(f"{output}/parts")
    done = read_ledger(spark, output)
    # A range cut off between its part and the ledger is not read; one row per range is broadcast.
    names = done.select(
        F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("first", "last")]).alias("rows")
    )
    return parts.join(F.broadcast(names), "rows", "left_semi")
