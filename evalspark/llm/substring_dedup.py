"""Removal of passages that repeat earlier text, by content-defined chunks.

A gear hash rolls over the bytes of a text, and the text is cut where its upper bits are zero, so cuts depend on the
32 bytes before them only: an insertion moves no cut further on. A cut that follows another
such place closely is left out. Chunks are compared by 128-bit digests; the first one in the order of (id, row, place)
owns a digest. Later chunks of the digest are repeats, and where repeats in a row hold at least ``MIN_RUN``
bytes they are cut out, so passages go but short phrases stay.

Most chunks occur once and never leave their task: a first pass counts them in a table of ``SLOTS`` places, and
only chunks whose place was hit twice are shuffled. The table's size does not depend on the input; if it fills up more
chunks are shuffled, with the same result.

Defined cases: null and empty texts have no chunks; a text that repeats as a whole becomes empty; rows with the
same id are told apart by their place in the table, which has to be a stored one; cuts never split a character; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.blocks import ODD, mix, text_blocks
from evalspark.llm.filters import packed, unpacked
from evalspark.session import materialize, ship_package

CUT_BITS = 5
MIN_GAP, MAX_CHUNK = 16, 1024
MIN_RUN = 100
SLOTS = 1 << 27
_WINDOW = 32
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD)) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a block of texts, every text's end among them."""
    h = _GEAR[data]
    step = 1
    while step < _WINDOW:
        # h[i] = sum of gear[data[i - k]] << k for k below the window.
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    ends = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends = ends[ends < len(data)]
    ends = ends[data[ends] & 0xC0 != 0x80]
    # The window has to lie in the text.
    text = np.searchsorted(offsets, ends, "right") - 1
    ends = ends[ends - offsets[text] >= _WINDOW]
    if len(ends):
        ends = ends[np.diff(ends, prepend=-MIN_GAP) >= MIN_GAP]
    ends = np.unique(np.concatenate([ends, offsets[1:][offsets[1:] > offsets[:-1]]]))
    long = np.flatnonzero(np.diff(ends, prepend=0) > MAX_CHUNK)
    if len(long):
        more = []
        for i in long.tolist():
            at, end = int(ends[i - 1]) if i else 0, int(ends[i])
            while end - at > MAX_CHUNK:
                at += MAX_CHUNK
                while data[at] & 0xC0 == 0x80:
                    at -= 1
                more.append(at)
        ends = np.unique(np.concatenate([ends, np.array(more, ends.dtype)]))
    return ends


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, start in the text, length, and the two halves of the digest of every chunk."""
    ends = cuts(data, offsets)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    whole, digest = data.tobytes(), xxhash.xxh3_128_digest
    spans = zip(starts.tolist(), ends.tolist())
    digests = np.frombuffer(b"".join([digest(whole[i:j]) for i, j in spans]), "<i8").reshape(-1, 2)
    text = np.searchsorted(offsets, starts, "right") - 1
    return text, starts - offsets[text], ends - starts, digests[:, 0], digests[:, 1]


def _slot(digest: np.ndarray) -> np.ndarray:
    return digest & (SLOTS - 1)


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.empty(0, np.int64)]
        for _, data, offsets in text_blocks(batch.column("text")):
            if len(data):
                found.append(_slot(chunks(data, offsets)[3]))
        slot, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot.astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int32))], ["slot", "n"]
        )


def _hit_twice(documents: DataFrame) -> np.ndarray:
    """A bit for each slot that more than one chunk hits; its size is fixed."""
    counted = documents.select("text").mapInArrow(_count_chunks, "slot int, n int")
    twice = counted.groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    bits = twice.groupBy(F.expr("slot div 64").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits")
    )
    got = bits.toArrow()
    table = np.zeros(SLOTS // 64, np.uint64)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


CHUNKS = "doc_id {kind}, row bigint, start bigint, length bigint, d1 bigint, d2 bigint"


def _chunker(twice: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_blocks(batch.column("text")):
                if not len(data):
                    continue
                text, start, length, d1, d2 = chunks(data, offsets)
                slot = _slot(d1).view(np.uint64)
                hit = twice.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))
                hit = (hit & np.uint64(1)).astype(bool)
                rows = pa.array(at + text[hit])
                arrays = [batch.column("doc_id").take(rows), batch.column("row").take(rows)]
                arrays += [pa.array(x[hit]) for x in (start, length, d1, d2)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "start", "length", "d1", "d2"])

    return run


def _runs(min_run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeats of a text, in order, to the runs that go, and the spans between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, left = [], []
            for repeats in batch.column("repeats").to_pylist():
                runs: list[list[int]] = []
                for x in repeats:
                    if runs and runs[-1][1] == x["start"]:
                        runs[-1][1] += x["length"]
                    else:
                        runs.append([x["start"], x["start"] + x["length"]])
                runs = [r for r in runs if r[1] - r[0] >= min_run]
                gone.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *[at for r in runs for at in r], None]
                left.append(
                    [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2]) if b is None or b > a]
                )
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(gone, span), pa.array(left, span)], ["row", "gone", "left"]
            )

    return run


def repeated_spans(documents: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``row``, ``gone`` and ``left``: byte spans that go, and those between them, of the texts that lose some.

    ``documents`` has ``doc_id``, ``row`` (a number of its own for every row) and ``text``.
    """
    spark = documents.sparkSession
    ship_package(spark)
    twice = spark.sparkContext.broadcast(_hit_twice(documents))
    kind = dict(documents.dtypes)["doc_id"]
    found = documents.select("doc_id", "row", "text").mapInArrow(_chunker(twice), CHUNKS.format(kind=kind))
    found = materialize(found, "chunks")
    owner = F.min(F.struct("doc_id", "row", "start")).alias("owner")
    owners = found.groupBy("d1", "d2").agg(owner, F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = found.join(owners, ["d1", "d2"]).where(F.struct("doc_id", "row", "start") != F.col("owner"))
    by_row = repeats.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("repeats"))
    span = "array<struct<start:bigint,end:bigint>>"
    return by_row.mapInArrow(_runs(min_run), f"row bigint, gone {span}, left {span}").where("size(gone) > 0")


def dedup_substrings(documents: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """All columns of ``documents``, with ``text`` without repeated passages; ``gone``, their byte spans.

    ``n_removed`` counts the bytes that went.
    """
    rows = packed(documents)
    texts = rows.select(F.col("own.doc_id").alias("doc_id"), "row", F.col("own.text").alias("text"))
    joined = rows.join(repeated_spans(texts, min_run), "row", "left")
    whole = F.col("own.text").cast("binary")

    def part(s: Column) -> Column:
        end = F.coalesce(s["end"], F.octet_length("own.text").cast("long"))
        return whole.substr((s["start"] + 1).cast("int"), (end - s["start"]).cast("int")).cast("string")

    left = F.array_join(F.transform("left", part), "")
    n_removed = F.aggregate("gone", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return joined.select(
        *unpacked(
            documents.columns,
            text=F.when(F.col("left").isNull(), F.col("own.text")).otherwise(left),
            n_removed=F.coalesce(n_removed, F.lit(0)),
            gone=F.col("gone"),
        )
    )
