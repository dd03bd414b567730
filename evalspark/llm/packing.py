"""Packing of documents into token sequences by a grouping genetic algorithm.

Documents are encoded once; only what is longer than a sequence is cut. Pieces that fill a sequence stand
alone. The others are dealt evenly to blocks of about ``BLOCK_ROWS`` pieces, by their row and not by a key, so
copies spread. A block is packed by several islands, each a Spark row: an individual is a set of
bins, crossover injects well-filled bins of one parent into the other, drops the bins that then hold an
item twice, and puts the displaced items back by best fit; mutation empties a few bins instead. An island evolves until it
needs no more bins than its tokens fill, or until ``PATIENCE`` items have been packed without a better individual. After
each epoch an island's elite moves to the next island of its block. The best individual of a block stands; what lies in its
badly filled bins is packed once more across blocks where that saves sequences, so blocks leave no remainders behind.

Defined cases: a null or empty text is the end token alone; a null id is carried; repeated rows give
pieces each, told apart by their place only; an empty table gives an empty result; columns other than the id and the text
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.tokens import default_vocabulary, encoder
from evalspark.session import materialize, ship_package

CAPACITY, END = 2048, 0
BLOCK_ROWS = 4096
ISLANDS, EPOCHS, POPULATION = 2, 2, 20
# Children without a gain after which an island stops: so many items over those of the block, and at least LEAST_CHILDREN.
PATIENCE, LEAST_CHILDREN = 40_000, 40
# Bins filled less than this share are opened again in the second round.
WELL_FILLED = 0.995
PIECE = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"


def _piece_maker(capacity: int, vocabulary: tuple[str, str], with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*vocabulary).encode
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            texts, of, rows, ids = batch.column("text"), [], [], []
            for i in range(len(texts)):
                tokens = encode(texts[i].as_py()) + end
                n = len(tokens) // 4
                stop = n % capacity or capacity
                at = k = 0
                while at < n:
                    own = tokens[4 * at : 4 * stop]
                    of.append(i)
                    rows.append((k, at, stop - at, zlib.crc32(own)))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                    at, stop, k = stop, stop + capacity, k + 1
            piece, start, length, crc = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
            arrays = [
                batch.column("doc_id").take(pa.array(of, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pieces(
    documents: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: tuple[str, str] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document, all of ``capacity`` tokens but the first; ``ids`` if asked for."""
    ship_package(documents.sparkSession)
    schema = PIECE.format(kind=dict(documents.dtypes)["doc_id"]) + (", ids array<int>" if with_ids else "")
    make = _piece_maker(capacity, vocabulary or default_vocabulary(), with_ids)
    return documents.select("doc_id", "text").mapInArrow(make, schema)


class _Plan:
    """An individual: bins of item numbers and how far each is filled."""

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills
        # Fewer bins first, then unevenly filled ones, which leave room to close a bin.
        self.fitness = (-len(bins), sum(f * f for f in fills))

    def __iter__(self) -> Iterator[list[int]]:
        return iter(self.bins)

    def __len__(self) -> int:
        return len(self.bins)


class _Packer:
    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths.tolist(), capacity
        self.random = np.random.default_rng(seed)

    def fill(self, content: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, content))

    def plan(self, bins: list[list[int]] | _Plan) -> _Plan:
        return _Plan(list(bins), [self.fill(b) for b in bins])

    def best_fit(self, bins: list[list[int]], fills: list[int], items: list[int]) -> _Plan:
        """Put items, in their order, where they leave the least room; changes ``bins`` and ``fills``."""
        room: dict[int, list[int]] = {}
        mask = 0
        for b, fill in enumerate(fills):
            gap = self.capacity - fill
            if gap:
                room.setdefault(gap, []).append(b)
                mask |= 1 << gap
        for item in items:
            n = self.lengths[item]
            fits = mask >> n
            if fits:
                gap = n + (fits & -fits).bit_length() - 1
                stack = room[gap]
                b = stack.pop()
                if not stack:
                    mask &= ~(1 << gap)
                bins[b].append(item)
                fills[b] += n
            else:
                gap, b = self.capacity, len(bins)
                bins.append([item])
                fills.append(n)
            gap -= n
            if gap:
                room.setdefault(gap, []).append(b)
                mask |= 1 << gap
        return _Plan(bins, fills)

    def fresh(self, noise: float) -> _Plan:
        keys = np.array(self.lengths) * (1 + noise * self.random.random(len(self.lengths)))
        return self.best_fit([], [], np.argsort(-keys, kind="stable").tolist())

    def _put_back(self, bins: list[list[int]], fills: list[int], items: list[int]) -> _Plan:
        items.sort(key=lambda i: (-self.lengths[i], i))
        return self.best_fit(bins, fills, items)

    def crossover(self, a: _Plan, b: _Plan) -> _Plan:
        half = sorted(b.fills)[len(b.fills) // 2]
        well = [i for i, f in enumerate(b.fills) if f >= half]
        chosen = self.random.choice(well, self.random.integers(1, max(1, len(well) // 2) + 1), replace=False).tolist()
        bins, fills = [list(b.bins[i]) for i in chosen], [b.fills[i] for i in chosen]
        inside = {item for x in bins for item in x}
        displaced: list[int] = []
        # The emptiest bin is given up too: its items may fit elsewhere.
        worst = min(range(len(a.fills)), key=a.fills.__getitem__)
        for i, content in enumerate(a.bins):
            if i != worst and inside.isdisjoint(content):
                bins.append(list(content))
                fills.append(a.fills[i])
            else:
                displaced.extend(item for item in content if item not in inside)
        return self._put_back(bins, fills, displaced)

    def mutate(self, a: _Plan) -> _Plan:
        gone = set(self.random.choice(len(a.bins), min(len(a.bins), 1 + self.random.integers(1, 4)), replace=False).tolist())
        gone.add(min(range(len(a.fills)), key=a.fills.__getitem__))
        bins = [list(x) for i, x in enumerate(a.bins) if i not in gone]
        fills = [f for i, f in enumerate(a.fills) if i not in gone]
        items = [item for i in gone for item in a.bins[i]]
        # Not by length alone, or the same bins would come back.
        order = self.random.permutation(len(items)).tolist()
        cut = self.random.integers(len(items) + 1)
        first = [items[i] for i in order[:cut]]
        plan = self.best_fit(bins, fills, sorted(first, key=lambda i: -self.lengths[i]))
        return self._put_back(plan.bins, plan.fills, [items[i] for i in order[cut:]])

    def evolve(self, elites: list[list[list[int]]]) -> list[list[int]]:
        least = -(-sum(self.lengths) // self.capacity)
        people = [self.plan(e) for e in elites] or [self.fresh(0.0)]
        best = max(people, key=lambda x: x.fitness)
        if len(best.bins) <= least:
            return best.bins
        while len(people) < POPULATION:
            people.append(self.fresh(0.3))
        patience = max(LEAST_CHILDREN, PATIENCE // len(self.lengths))
        idle = 0
        while idle < patience:
            # Of two drawn at random the better one is a parent.
            drawn = self.random.choice(len(people), 4, replace=False).tolist()
            a, b = (max((people[i] for i in pair), key=lambda x: x.fitness) for pair in (drawn[:2], drawn[2:]))
            child = self.crossover(a, b) if self.random.random() < 0.7 else self.mutate(a)
            best = max(people, key=lambda x: x.fitness)
            idle = 0 if child.fitness > best.fitness else idle + 1
            if len(child.bins) <= least:
                return child.bins
            worst = min(range(len(people)), key=lambda i: people[i].fitness)
            if child.fitness > people[worst].fitness and all(child.fitness != x.fitness for x in people):
                people[worst] = child
        return max(people, key=lambda x: x.fitness).bins


def _bins(code: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(code.max()) + 1)] if len(code) else []
    for item, b in enumerate(code.tolist()):
        bins[b].append(item)
    return bins


def _codes(bins: list[list[int]], n: int) -> list[int]:
    code = np.zeros(n, np.int32)
    for b, content in enumerate(bins):
        code[content] = b
    return code.tolist()


ISLAND = "block bigint, island int, lengths array<int>, elite array<int>, n_bins int"


def _island(capacity: int, epoch: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, island = (batch.column(c)[i].as_py() for c in ("block", "island"))
                lengths = batch.column("lengths")[i].values.to_numpy()
                packer = _Packer(lengths, capacity, hash((block, island, epoch)) & 0xFFFFFFFF)
                best = packer.evolve([_bins(np.array(e, np.int32)) for e in batch.column("elites")[i].as_py()])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([island], pa.int32()),
                        pa.array([lengths], pa.list_(pa.int32())),
                        pa.array([_codes(best, len(lengths))], pa.list_(pa.int32())),
                        pa.array([len(best)], pa.int32()),
                    ],
                    ["block", "island", "lengths", "elite", "n_bins"],
                )

    return run


def _pack_round(items: DataFrame, capacity: int, block_rows: int, islands: int, epochs: int) -> DataFrame:
    """``items`` (a stored table) with ``block``, ``bin`` and ``fill``, the bin's tokens."""
    n = items.count()
    n_blocks = max(1, -(-n // block_rows))
    columns = items.columns
    dealt = items.withColumn("row", F.monotonically_increasing_id())
    blocks = dealt.groupBy(F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("length").alias("size"), "row", *columns))).alias("items")
    )
    blocks = materialize(blocks, "blocks")
    lengths = F.transform("items", lambda x: x["size"].cast("int"))
    state = blocks.select(
        "block", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), lengths.alias("lengths")
    ).withColumn("elites", F.expr("cast(array() AS array<array<int>>)"))
    for epoch in range(epochs):
        # A number of partitions that adaptive execution does not lower: rows are few, their work is not.
        state = state.repartition(min(islands * n_blocks, 4096), "block", "island")
        elites = materialize(state.mapInArrow(_island(capacity, epoch), ISLAND), "islands")
        moved = elites.withColumn("island", (F.col("island") + 1) % islands)
        # At most two rows meet: an island's own elite and its neighbour's.
        state = (
            elites.unionByName(moved)
            .groupBy("block", "island")
            .agg(F.first("lengths").alias("lengths"), F.sort_array(F.collect_set("elite")).alias("elites"))
        )
    best = elites.groupBy("block").agg(F.min_by("elite", F.struct("n_bins", "island")).alias("bins"))
    placed = blocks.join(best, "block").select(
        "block", F.explode(F.arrays_zip("items", "bins")).alias("x")
    )
    placed = placed.select("block", F.col("x.bins").alias("bin"), *[F.col("x.items")[c].alias(c) for c in columns])
    fills = placed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    return materialize(placed.join(fills, ["block", "bin"]), "placed")


def pack(
    cut: DataFrame,
    capacity: int = CAPACITY,
    block_rows: int = BLOCK_ROWS,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
) -> DataFrame:
    """Pieces (a stored table) with ``sequence_id`` and ``offset``, their place in a sequence."""
    columns = cut.columns
    whole = cut.where(F.col("length") >= capacity)
    alone = whole.select(
        *columns,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    items = materialize(cut.where(F.col("length") < capacity), "items")
    first = _pack_round(items, capacity, block_rows, islands, epochs)
    open_ = F.col("fill") < WELL_FILLED * capacity
    again = _pack_round(
        materialize(first.where(open_).select(*columns), "displaced"), capacity, block_rows, islands, epochs
    )
    sequences = F.count_distinct("block", "bin").alias("n")
    # Bins are opened for a second round only where that needs fewer of them.
    fewer = again.agg(sequences).first()["n"] < first.where(open_).agg(sequences).first()["n"]
    packed = None
    for placed, base in ((first.where(~open_), 0), (again, 1 << 62)) if fewer else ((first, 0),):
        # Rounds, blocks and bins have digits of their own.
        number = F.lit(base) + F.col("block") * (1 << 20) + F.col("bin")
        placed = placed.withColumn("sequence_id", number.cast("long")).select(*columns, "sequence_id")
        packed = placed if packed is None else packed.unionByName(placed)
    # A sequence holds at most ``capacity`` pieces, so its window is small.
    offset = F.expr(
        "sum(length) OVER (PARTITION BY sequence_id ORDER BY length DESC, doc_id, piece "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    packed = packed.withColumn("offset", F.coalesce(offset, F.lit(0)))
    return packed.unionByName(alone)


def pack_documents(
    documents: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str] | None = None
) -> DataFrame:
    return pack(materialize(pieces(documents, capacity, vocabulary), "pieces"), capacity)
