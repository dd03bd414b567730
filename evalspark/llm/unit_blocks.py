"""Encoding of texts by their different units: blocks of texts ask for their units, each unit is encoded once for all.

A block is a run of whole rows of a partition, of about a given number of bytes of text. It asks for its different units by
number, in the order of first use; units are grouped over all blocks, encoded, and their ids go back to the blocks by
number, as a compressed run per task and block. Texts travel as one compressed frame per block, not as rows, and meet the ids of their units there.

Blocks are cut twice, once for units and once for frames, so their keys are digests of their place and of their texts: should the
two passes ever see other rows, keys or numbers do not fit and the job stops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Answers of a task that are packed together.
HELD_ANSWERS = 1 << 19
# Returns the function that cuts a text into units; called once per task.
MakeCut = Callable[[], Callable[[str], list[str]]]


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows and their keys; where they end depends on the texts of the partition alone."""
    part, number, held = TaskContext.get().partitionId(), 0, 0
    slices: list[pa.RecordBatch] = []
    seen, sizes = blake2b(), blake2b()

    def key() -> int:
        whole = blake2b(b"%d %d " % (part, number) + seen.digest() + sizes.digest(), digest_size=8)
        return int.from_bytes(whole.digest(), "little", signed=True)

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("text").cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            end = int(np.searchsorted(offsets, offsets[at] + block_bytes - held))
            full, end = end <= len(texts), min(end, len(texts))
            seen.update(data[offsets[at] : offsets[end]].tobytes())
            sizes.update(np.diff(offsets[at : end + 1]).tobytes())
            slices.append(batch.slice(at, end - at))
            held += int(offsets[end] - offsets[at])
            at = end
            if full:
                yield key(), pa.Table.from_batches(slices)
                number, held, slices = number + 1, 0, []
                seen, sizes = blake2b(), blake2b()
    if slices:
        yield key(), pa.Table.from_batches(slices)


def _texts(table: pa.Table) -> Iterator[str]:
    for chunk in table.column("text").chunks:
        for text in chunk:
            yield text.as_py() or ""


def _asked(make_cut: MakeCut, block_bytes: int, known: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, first = make_cut(), dict(known.value)
        for key, table in _blocks(batches, block_bytes):
            found: dict[str, None] = {}
            for text in _texts(table):
                found.update(dict.fromkeys(cut(text)))
            units = [u for u in found if u not in first]
            for at in range(0, len(units), 1 << 14):
                part = units[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), key, np.int64)),
                        pa.array(np.arange(at, at + len(part), dtype=np.int32)),
                        pa.array(part, pa.string()),
                    ],
                    ["block", "number", "unit"],
                )

    return run


def _frames(block_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _blocks(batches, block_bytes):
            out = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
            with pa.ipc.new_stream(out, table.schema, options=options) as stream:
                stream.write_table(table.combine_chunks())
            frame = pa.array([out.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), frame], ["block", "frame"])

    return run


class _InOrder(dict):
    """The next of ``values`` for each new key, those of ``known`` apart."""

    def __init__(self, known: Iterable[tuple[str, bytes]], values: Iterable[bytes]):
        super().__init__(known)
        self.values_left = iter(values)

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.take()
        return value

    def take(self) -> bytes:
        for value in self.values_left:
            return value
        raise ValueError("a block has a unit that it did not ask for")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers of a task as a compressed run per block: how many, their numbers, their sizes, their ids."""

    def runs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = np.concatenate([b.column("block").to_numpy() for b in held])
        number = np.concatenate([b.column("number").to_numpy() for b in held])
        flat = np.concatenate([b.column("ids").flatten().to_numpy(zero_copy_only=False) for b in held]).astype("<i4")
        sizes = np.concatenate([b.column("ids").value_lengths().to_numpy(zero_copy_only=False) for b in held])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        order = np.lexsort((number, block))
        block, number, sizes, starts = block[order], number[order], sizes[order], starts[order]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, sizes)
        flat = flat[np.repeat(starts, sizes) + place]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        frames = []
        for i, j in zip(edges, edges[1:]):
            raw = np.concatenate([[j - i], number[i:j], sizes[i:j], flat[ends[i] : ends[j]]]).astype("<i4").tobytes()
            frames.append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(frames, pa.binary())], ["block", "frame"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= HELD_ANSWERS:
            yield runs(held)
            held, n = [], 0
    if held:
        yield runs(held)


def _unpacked(frames: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, sizes and ids of all runs."""
    parts = [(np.empty(0, "<i4"),) * 3]
    for frame in frames:
        whole = frame.as_py()
        raw = np.frombuffer(pa.decompress(whole[8:], int.from_bytes(whole[:8], "little"), "zstd"), "<i4")
        n = int(raw[0])
        parts.append((raw[1 : 1 + n], raw[1 + n : 1 + 2 * n], raw[1 + 2 * n :]))
    return tuple(map(np.concatenate, zip(*parts)))


def _in_order(sizes: np.ndarray, flat: np.ndarray, order: np.ndarray) -> Iterator[bytes]:
    """The ids of one unit after the other, as little-endian 32-bit bytes."""
    ends = np.cumsum(sizes, dtype=np.int64)
    for at in range(0, len(order), 1 << 14):
        part = order[at : at + (1 << 14)]
        for i, j in zip((ends[part] - sizes[part]).tolist(), ends[part].tolist()):
            yield flat[i:j].tobytes()


def _replaced(names: list[str], make_cut: MakeCut, known: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(frames: pa.Table, units: pa.Table) -> pa.Table:
        if frames.num_rows != 1:
            raise ValueError("the texts of a block changed between two passes over the table")
        numbers, sizes, flat_ids = _unpacked(units.column("frame"))
        order = np.argsort(numbers)
        if not np.array_equal(numbers[order], np.arange(len(numbers))):
            raise ValueError("units of a block are missing")
        cut, of = make_cut(), _InOrder(known.value, _in_order(sizes, flat_ids, order))
        table = pa.ipc.open_stream(frames.column("frame")[0].as_buffer()).read_all()
        ends, flat = [0], bytearray()
        for text in _texts(table):
            flat += b"".join(map(of.__getitem__, cut(text)))
            ends.append(len(flat) // 4)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, "<i4")))
        return pa.table([*[table.column(c) for c in names], lists], [*[f"own_{i}" for i in range(len(names))], "ids"])

    return run


def encode_blocks(
    documents: DataFrame,
    keep: tuple[str, ...],
    make_cut: MakeCut,
    encode_units: Callable[[DataFrame], DataFrame],
    block_bytes: int,
    known: Iterable[tuple[str, bytes]] = (),
) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array<int>), the ids of the units of ``text`` in a row, one row per document.

    ``encode_units`` gets different units as ``unit`` and ``blocks`` (an array, to be passed on) and adds ``ids``.
    ``known`` are units whose ids, as little-endian 32-bit bytes, need not be asked for.
    """
    kinds = dict(documents.dtypes)
    names = ["text" if c == "text" else f"own_{i}" for i, c in enumerate(keep)]
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names) if n != "text"]
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ahead = documents.sparkSession.sparkContext.broadcast(list(known))
    asked = documents.select("text").mapInArrow(
        _asked(make_cut, block_bytes, ahead), "block bigint, number int, unit string"
    )
    # A block has a unit once, so there is nothing to combine before the shuffle.
    units = asked.repartition("unit").groupBy("unit").agg(F.collect_list(F.struct("block", "number")).alias("blocks"))
    answers = encode_units(units).select(F.explode("blocks").alias("at"), "ids").select("at.block", "at.number", "ids")
    runs = answers.mapInArrow(_packed, "block bigint, frame binary")
    frames = documents.select(*own, "text").mapInArrow(_frames(block_bytes), "block bigint, frame binary")
    # Twice as many tasks as full blocks, as several blocks may fall to one.
    frames = frames.repartition(2 * max(1, -(-total // block_bytes)), "block")
    schema = ", ".join([*[f"own_{i} {kinds[c]}" for i, c in enumerate(keep)], "ids array<int>"])
    coded = frames.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(
        _replaced(names, make_cut, ahead), schema
    )
    return coded.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(keep)], "ids")
