"""Multi-line CSV files read by many tasks each.

A quoted field may hold line breaks, so whether a line begins a record depends on all text before it. But a line knows
how it ends for both cases, inside a quoted field and outside, and such pairs of outcomes combine in any order:

1. Spark splits the files into ranges of whole lines. Each range is reduced to its outcome for both cases, with its
   numbers of lines, and a running combination over the ranges of a file tells how each range begins.
2. Knowing that, every range cuts its own records. Only the pieces of a record that goes on in a later range are
   shuffled, at most two per range, and put together.
3. Spark's own parser turns the records into columns.

Files are read twice and never shuffled. What is broadcast has one row per range of a file, and a range has
``spark.sql.files.maxPartitionBytes`` (128 MB if unset) unless the file is smaller; lines have to meet it in their order, so
each range's number of lines and last state are checked against those of the first pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.session import materialize, ship_package

LINES = "file string, start bigint, value string"
RANGES = "file string, start bigint, n bigint, if_outside boolean, if_inside boolean, modified bigint"
PIECES = "file string, start bigint, line bigint, piece int, record string"


def _after_quote(quote: str) -> re.Pattern:
    """From inside a quoted field to the end of it; two quotes are one that belongs to the text."""
    q = re.escape(quote)
    return re.compile(f"[^{q}]*(?:{q}{q}[^{q}]*)*{q}(?!{q})")


class Lines:
    """Where lines end, for a delimiter and a quote of one character each."""

    def __init__(self, delimiter: str = ",", quote: str = '"'):
        if len(delimiter) != 1 or len(quote) != 1:
            raise ValueError("the delimiter and the quote must be one character each")
        self.delimiter, self.quote = delimiter, quote
        self.closed = _after_quote(quote).match

    def ends_inside(self, line: str, inside: bool) -> bool:
        """Whether a quoted field is open at the end of the line.

        A quote opens a field only as its first character. What follows a closing quote, up to the delimiter, is
        not quoted whatever it is.
        """
        if self.quote not in line:
            return inside
        at = 0
        while True:
            if inside or line.startswith(self.quote, at):
                end = self.closed(line, at if inside else at + 1)
                if end is None:
                    return True
                at, inside = end.end(), False
            at = line.find(self.delimiter, at) + 1
            if not at:
                return False


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str]]]:
    """The lines of the batch by file and range."""
    starts, files = batch.column("start").to_numpy(), batch.column("file").dictionary_encode()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
    values = batch.column("value").to_pylist()
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
        yield files.dictionary[int(codes[a])].as_py(), int(starts[a]), values[a:b]


def _outcomes(lines: Lines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            file, start = key
            values = [[file], [start], [n], [ends[0]], [ends[1]], [modified]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)],
                ["file", "start", "n", "if_outside", "if_inside", "modified"],
            )

        key, n, ends, modified = None, 0, (False, True), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            times, at = batch.column("modified"), 0
            for file, start, values in _runs(batch):
                if (file, start) != key:
                    if key is not None:
                        yield row()
                    key, n, ends, modified = (file, start), 0, (False, True), times[at].as_py()
                at += len(values)
                for line in values:
                    ends = tuple(lines.ends_inside(line, e) for e in ends) if lines.quote in line else ends
                n += len(values)
        if key is not None:
            yield row()

    return run


def _records(lines: Lines):
    """Whole records, and the pieces of those that begin or end elsewhere.

    ``piece`` is 0 for a whole record, 1 for one that goes on in a later range, 2 for the lines of a range up to the end of a
    record that began before, 3 for a range without such an end. ``line`` is the number of the first line in the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, int, str]] = []
        key, held, began, inside, first, number, due = None, [], 0, False, False, 0, (0, False)

        def rest() -> None:
            if key is not None and (number, inside) != due:
                raise ValueError(f"lines of {key} are not those that were read before")
            if held:
                out.append((*key, began, 3 if first else 1, "\n".join(held)))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            columns = [pa.array(v, k) for v, k in zip(zip(*out), kinds)]
            return pa.RecordBatch.from_arrays(columns, ["file", "start", "line", "piece", "record"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = 0
            begins, insides, ends, closes = map(batch.column, ("begin", "inside", "end", "ends_inside"))
            for file, start, values in _runs(batch):
                if (file, start) != key:
                    rest()
                    key, held = (file, start), []
                    number, inside = begins[at].as_py(), insides[at].as_py()
                    due = (ends[at].as_py(), closes[at].as_py())
                    # The first lines belong to a record of an earlier range.
                    first = inside
                at += len(values)
                for line in values:
                    if not held:
                        began = number
                    held.append(line)
                    number += 1
                    inside = lines.ends_inside(line, inside)
                    if not inside:
                        out.append((*key, began, 2 if first else 0, "\n".join(held) if len(held) > 1 else line))
                        held, first = [], False
            if out:
                yield batch_of()
                out.clear()
        rest()
        if out:
            yield batch_of()

    return run


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under ``path``, with file, range and time of the file; other line breaks stay in the lines."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.unix_micros("_metadata.file_modification_time").alias("modified"),
        "value",
    )


def _starts(ranges: DataFrame) -> DataFrame:
    """How each range begins and ends: numbers of lines, and whether inside a quoted field.

    A range that forgets how it began (both outcomes are the same) settles what follows, and most do. One that does not
    either keeps the state or turns it around; so the state is that of the last settling range, turned by the number of
    those in between that turn it.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("if_outside") == F.col("if_inside")
    turned = F.when(~settles & F.col("if_outside"), 1).otherwise(0)
    marked = ranges.withColumns(
        {"turns": F.sum(turned).over(before.rowsBetween(Window.unboundedPreceding, 0)), "settles": settles}
    )
    last = F.last(F.when(F.col("settles"), F.struct("if_outside", "turns")), ignorenulls=True).over(before)
    so_far = F.coalesce(F.lag("turns").over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    state = marked.select(
        "file", "start", "n", "if_outside", "if_inside", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"),
        last.alias("last"), so_far.alias("so_far"),
    )
    odd = (F.col("so_far") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    settled = F.coalesce("last.if_outside", F.lit(False))
    state = state.withColumn("inside", settled != odd)
    closes = F.when(F.col("inside"), F.col("if_inside")).otherwise(F.col("if_outside"))
    return state.select(
        "file", "start", "begin", (F.col("begin") + F.col("n")).alias("end"), "inside", closes.alias("ends_inside")
    )


def read_records(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """The records of CSV files as text: ``file``, ``line``, ``position`` and ``record``.

    ``line`` is the number of the record's first line in its file, from 0. ``position`` goes on from file to file, by time
    of change and name, so it orders the records of a folder and is the same in every run.
    """
    ship_package(spark)
    rules = Lines(delimiter, quote)
    lines = read_lines(spark, path)
    ranges = materialize(lines.mapInArrow(_outcomes(rules), RANGES), "csv-ranges")
    known = lines.drop("modified").join(F.broadcast(_starts(ranges)), ["file", "start"])
    pieces = known.mapInArrow(_records(rules), PIECES)
    whole = pieces.where("piece = 0").select("file", "line", "record")
    # A record in pieces: the number of beginnings up to a piece names its record.
    cut = pieces.where("piece > 0")
    order = Window.partitionBy("file").orderBy("line")
    named = cut.withColumn("nth", F.sum((F.col("piece") == 1).cast("int")).over(order))
    joined = named.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("line", "record"))).alias("parts"))
    across = joined.select(
        "file",
        F.get("parts", F.lit(0))["line"].alias("line"),
        F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
    )
    # One row per file.
    files = ranges.groupBy("file").agg(F.sum("n").alias("n"), F.max("modified").alias("modified"))
    earlier = Window.orderBy("modified", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before"))
    return whole.unionByName(across).join(F.broadcast(files), "file").select(
        "file", "line", (F.col("lines_before") + F.col("line")).alias("position"), "record"
    )


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """The columns of ``schema``, and ``position`` in front, which orders the rows of all files.

    Like Spark's multi-line reader with ``header``, doubled quotes and checked column names: the first record of each file
    has to name the columns, empty lines are no rows, and a record with too few or too many fields stops the job.
    """
    records = read_records(spark, path, options.get("sep", ","), options.get("quote", '"'))
    text = F.regexp_replace("record", "\r$", "")
    records = records.select("line", "position", text.alias("record")).where("record <> ''")
    parser = {k: v for k, v in options.items() if k not in ("header", "enforceSchema")}
    names = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema.names))])

    def ddl(kind: T.StructType) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)

    # A byte order mark may stand before the first name.
    head = F.from_csv(F.ltrim(F.col("record"), F.lit("﻿")), ddl(names), parser)
    wanted = F.array(*[F.lit(n.lower()) for n in schema.names])
    same = F.transform(F.array(*[head[c] for c in names.names]), F.lower) == wanted
    refused = F.raise_error(F.concat(F.lit("columns differ from the schema: "), "record"))
    row = F.when(F.col("line") > 0, F.from_csv("record", ddl(schema), parser)).when(~same, refused.cast(schema))
    parsed = records.select("position", row.alias("row"))
    return parsed.where("row IS NOT NULL").select("position", "row.*")
