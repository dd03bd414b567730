"""Fill-in-middle transformation on texts that are stored as seekable compressed frames.

``store_frames`` cuts each text into independent zstandard frames of ``FRAME_UNITS`` code points. A frame carries
the number of units in front of it, so that any unit is found by a binary search, and only its frame is decompressed.
``fill_in_middle`` draws two cuts per text from a hash of its id, decompresses the frames that hold them, and puts
the parts in another order with a marker in front of each: all other frames are moved as they are. The result is
stored as frames too. ``restored`` finds the markers in such an output and puts its frames back; ``with_digests``
streams the frames of a column through a hash, so neither needs more than one frame in the clear at a time.

Everything happens to one row at a time: there is no shuffle, and a lost task is repeated from its input rows.

Defined cases: a null text is an empty one; an empty text, and one that holds a marker, stays plain; a null id counts
as an empty string in the hash, so its rows share their draws as repeated rows do; repeated rows give a row each; an empty
table gives an empty result. Other columns are kept only if ``keep`` names them; a kept column with the name of a new
one is refused.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.session import materialize, ship_package

FRAME_UNITS = 8192
LEVEL = 3
# Compressed bytes that a task holds before it passes a batch on.
BATCH_BYTES = 4 << 20
FRAMES = "array<struct<start:bigint,units:int,data:binary>>"
_FRAME = pa.struct([("start", pa.int64()), ("units", pa.int32()), ("data", pa.binary())])


class Markers(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Frame(NamedTuple):
    """``units`` code points, compressed on their own, after ``start`` others."""

    start: int
    units: int
    data: bytes


class _Codec:
    """Compression within a task; keeps the last frame that it opened."""

    def __init__(self) -> None:
        import zstandard

        self._pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self._open = zstandard.ZstdDecompressor().decompress
        self._last: tuple[bytes, bytes] = (b"", b"")

    def pack(self, text: str, start: int = 0) -> Frame:
        return Frame(start, len(text), self._pack(text.encode()))

    def open(self, frame: Frame) -> bytes:
        if self._last[0] is not frame.data:
            self._last = (frame.data, self._open(frame.data))
        return self._last[1]


def _placed(frames: Iterator[Frame]) -> list[Frame]:
    """The frames in a row, with their starts."""
    out, at = [], 0
    for f in frames:
        out.append(Frame(at, f.units, f.data))
        at += f.units
    return out


def _between(codec: _Codec, frames: list[Frame], low: int, high: int) -> Iterator[Frame]:
    """Frames of the units from ``low`` to ``high``; the first and the last are cut, the others stay as they are."""
    k = max(bisect_right(frames, low, key=lambda f: f.start) - 1, 0)
    while low < high:
        f = frames[k]
        end = min(f.start + f.units, high)
        if end - low == f.units:
            yield f
        else:
            yield codec.pack(codec.open(f).decode()[low - f.start : end - f.start])
        low, k = end, k + 1


def _frames_of(column: pa.Array) -> Iterator[list[Frame]]:
    flat = column.flatten()
    starts, units = (flat.field(c).to_numpy().tolist() for c in ("start", "units"))
    data, at = flat.field("data"), 0
    for n in column.value_lengths().to_pylist():
        n = n or 0
        yield [Frame(starts[i], units[i], data[i].as_py()) for i in range(at, at + n)]
        at += n


def _column(rows: list[list[Frame]]) -> pa.Array:
    flat = [f for r in rows for f in r]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    parts = [pa.array([f[i] for f in flat], t.type) for i, t in enumerate(_FRAME)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(_FRAME)))


def _by_row(
    df: DataFrame, keep: list[str], new: dict[str, str], make: Callable[[], Callable[[pa.RecordBatch, int], tuple]]
) -> DataFrame:
    """``df`` with the columns ``keep`` and ``new``, whose values ``make()(batch)`` yields for each row in turn."""
    kinds = dict(df.dtypes)
    clash = sorted(set(keep) & set(new))
    if clash:
        raise ValueError(f"kept columns with names of new ones: {clash}")
    ship_package(df.sparkSession)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"{c} {t}" for c, t in new.items()]])
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values_of = make()
        for batch in batches:
            rows: list[tuple] = []
            first, held = 0, 0

            def out() -> pa.RecordBatch:
                columns = [batch.column(c).slice(first, len(rows)) for c in keep]
                for (_, t), values in zip(new.items(), zip(*rows)):
                    columns.append(_column(list(values)) if t == FRAMES else pa.array(values, types[t]))
                return pa.RecordBatch.from_arrays(columns, [*keep, *new])

            for row in values_of(batch):
                rows.append(row)
                held += 64 + sum(len(f.data) for v in row if isinstance(v, list) for f in v)
                if held > BATCH_BYTES:
                    yield out()
                    first, rows, held = first + len(rows), [], 0
            if rows:
                yield out()

    return df.mapInArrow(run, schema)


def _store(markers: Markers) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    codec = _Codec()

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for cell in batch.column("text"):
            text = cell.as_py() or ""
            frames = [codec.pack(text[i : i + FRAME_UNITS], i) for i in range(0, len(text), FRAME_UNITS)]
            yield len(text), any(m in text for m in markers), frames

    return rows


def store_frames(
    documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), markers: Markers = Markers()
) -> DataFrame:
    """``keep``, ``n`` (code points of ``text``), ``marked`` (it holds a marker) and ``frames``, as a stored table."""
    new = {"n": "bigint", "marked": "boolean", "frames": FRAMES}
    columns = list(dict.fromkeys([*keep, "text"]))
    return materialize(_by_row(documents.select(*columns), list(keep), new, partial(_store, markers)), "frames")


def draw(doc_id: object, salt: str = "1:") -> list[int]:
    """Four unsigned 32-bit numbers from the id."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def _move(id_column: str, markers: Markers, plain: int, spm: int) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    codec = _Codec()
    p, s, m = (codec.pack(x) for x in markers)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        cells = zip(batch.column(id_column), batch.column("n"), batch.column("marked"), _frames_of(batch.column("frames")))
        for doc_id, n, marked, frames in cells:
            n = n.as_py()
            h1, h2, h3, h4 = draw(doc_id.as_py())
            if not n or marked.as_py() or h3 % 100 >= 100 - plain:
                yield "plain", None, None, frames
                continue
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            head, middle, tail = (
                list(_between(codec, frames, a, b)) for a, b in ((0, low), (low, high), (high, n))
            )
            if h4 % 100 < spm:
                form, order = "spm", [s, *tail, p, *head, m, *middle]
            else:
                form, order = "psm", [p, *head, s, *tail, m, *middle]
            yield form, low, high - low, _placed(iter(order))

    return rows


def fill_in_middle(
    framed: DataFrame,
    keep: tuple[str, ...] = ("doc_id", "n"),
    id_column: str = "doc_id",
    markers: Markers = Markers(),
    plain_percent: int = 10,
    spm_percent: int = 20,
) -> DataFrame:
    """``keep``, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output`` as frames.

    ``framed`` comes from ``store_frames`` with the same markers. ``spm_percent`` is a share of what is not plain.
    """
    new = {"form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": FRAMES}
    columns = list(dict.fromkeys([*keep, id_column, "n", "marked", "frames"]))
    make = partial(_move, id_column, markers, plain_percent, spm_percent)
    return _by_row(framed.select(*columns), list(keep), new, make)


def _find(codec: _Codec, frames: list[Frame], marker: str, unit: int) -> int:
    """The first unit at or after ``unit`` where ``marker`` stands, though it may lie across frames."""
    k = max(bisect_right(frames, unit, key=lambda f: f.start) - 1, 0)
    held, at = "", unit
    while k < len(frames):
        f = frames[k]
        held += codec.open(f).decode()[max(unit - f.start, 0) :]
        found = held.find(marker)
        if found >= 0:
            return at + found
        left = min(len(held), len(marker) - 1)
        at, held, k = at + len(held) - left, held[len(held) - left :], k + 1
    raise ValueError(f"no {marker} in an output that should have one")


def _restore(markers: Markers) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    codec = _Codec()

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for form, frames in zip(batch.column("form").to_pylist(), _frames_of(batch.column("output"))):
            if form == "plain":
                yield (frames,)
                continue
            order = (markers.prefix, markers.suffix, markers.middle)
            first, second, third = (order[1], order[0], order[2]) if form == "spm" else order
            after = len(first)
            a = _find(codec, frames, second, after)
            b = _find(codec, frames, third, a + len(second))
            parts = {first: (after, a), second: (a + len(second), b)}
            end = frames[-1].start + frames[-1].units
            spans = (parts[markers.prefix], (b + len(third), end), parts[markers.suffix])
            yield (_placed(f for low, high in spans for f in _between(codec, frames, low, high)),)

    return rows


def restored(moved: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """``moved`` with ``restored``, the frames of the text that ``output`` and ``form`` were made of."""
    return _by_row(moved, moved.columns, {"restored": FRAMES}, partial(_restore, markers))


def _digest(column: str) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    codec = _Codec()

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for frames in _frames_of(batch.column(column)):
            whole = hashlib.sha256()
            for f in frames:
                whole.update(codec.open(f))
            yield (whole.hexdigest(),)

    return rows


def with_digests(framed: DataFrame, digests: dict[str, str]) -> DataFrame:
    """Columns of frames replaced by the SHA-256 of their texts: ``digests`` is old name: new name."""
    for column, name in digests.items():
        keep = [c for c in framed.columns if c != column]
        framed = _by_row(framed, keep, {name: "string"}, partial(_digest, column))
    return framed


def _text(column: str) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    codec = _Codec()

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for frames in _frames_of(batch.column(column)):
            yield ("".join(codec.open(f).decode() for f in frames),)

    return rows


def with_text(framed: DataFrame, column: str, name: str = "text") -> DataFrame:
    """A column of frames replaced by its text."""
    return _by_row(framed, [c for c in framed.columns if c != column], {name: "string"}, partial(_text, column))


def _span(column: str) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    codec = _Codec()

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        lows, highs = (batch.column(c).to_pylist() for c in ("low", "high"))
        for low, high, frames in zip(lows, highs, _frames_of(batch.column(column))):
            end = frames[-1].start + frames[-1].units if frames else 0
            low, high = max(low or 0, 0), end if high is None else min(high, end)
            yield ("".join(codec.open(f).decode() for f in _between(codec, frames, low, high)),)

    return rows


def select_span(framed: DataFrame, column: str = "frames", name: str = "span") -> DataFrame:
    """``framed`` with ``name``, its units from ``low`` to ``high`` (columns); opens only the frames of that span."""
    return _by_row(framed, framed.columns, {name: "string"}, partial(_span, column))
