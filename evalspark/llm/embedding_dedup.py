"""Near-duplicate vectors by inverted lists with product-quantised residuals.

Equal vectors are one class with a weight. Classes are unit vectors in coarse cells; within a cell a
vector is known by the codes of its residual's parts. Neighbouring cells form groups, and groups blocks of bounded size,
each with its own task. Two vectors of different groups are compared in one of the two, in turns, so that all groups have
as much to do.

First only codes travel: a vector's codes are sent to every block that may hold vectors near it, if the border of one of
its group's cells is near enough, and the block says which of them, and which of its own vectors, may be in a link. A
block's distances to what the codes stand for are one product of matrices. Then the vectors that may be in a link travel
whole, to those blocks only; there the codes are looked at again cell by cell, and what they leave is reranked by exact cosines in double
precision, so no pair below the limit is linked. A task returns counts and a spanning forest per vector, never its pairs.

Both passes hold one block and a batch of the vectors that come to it, whatever the number of vectors. The
product of the first pass still grows as the square of that number where no border prunes.

Cells and codes are fitted on a bounded sample (``SAMPLE`` vectors, or fewer of many dimensions); every
vector is in the index. Both filters are triangle inequalities: two vectors at most the radius apart are no further than
that from any border between them, and a code is no further from the vector than what it leaves out. So no linked pair
is missed, however the vectors lie.

Defined cases: vectors that are null, zero, of another length than most, or that hold nulls, NaN or infinities link
with nothing and are their own component; copies link with each other; rows with the same id stay rows of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import filters
from evalspark.llm.components import components, forest
from evalspark.session import materialize, ship_package

SIMILARITY = 0.9
SAMPLE, SAMPLE_NUMBERS = 1 << 15, 1 << 22
CELL_ROWS, MAX_CELLS = 200, 2048
# Rows of a block and of a group; of many vectors a 32nd part, but for ``BLOCK_NUMBERS``.
BLOCK_ROWS = 4096
GROUP_ROWS = 4096
BLOCK_NUMBERS = 1 << 23
PART, CODES, BOOK_ROWS = 4, 256, 1 << 13
# Bytes of a row of packed vectors, and distances or numbers in memory at once.
PACK = 1 << 14
AT_ONCE = 1 << 21
# Room for rounding, in double and in single precision.
SLACK = 1e-9
SINGLE_SLACK = 1e-5
ROUNDS = 8


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaling by the largest component first avoids overflow."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _means(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm."""
    centers = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        of = _nearest(x, centers)[0]
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ y.T) + np.einsum("ij,ij->i", y, y)[None]
    return np.maximum(d, 0)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of, least = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 4096):
        d = _square_distances(x[at : at + 4096], centers)
        of[at : at + 4096] = d.argmin(axis=1)
        least[at : at + 4096] = d.min(axis=1)
    return of, least


class Index:
    """Coarse centers and code books; its size is bounded by the sample it was fitted on."""

    def __init__(self, sample: np.ndarray, n_rows: int, similarity: float):
        random = np.random.default_rng(7)
        x = unit(sample)
        self.dimension = x.shape[1]
        self.similarity = similarity
        k = int(min(max(1, n_rows // CELL_ROWS), MAX_CELLS, max(1, len(x) // 8)))
        self.centers = _means(x, k, random)
        rest = x - self.centers[_nearest(x, self.centers)[0]]
        self.parts = [slice(at, min(at + PART, self.dimension)) for at in range(0, self.dimension, PART)]
        rest = rest[:BOOK_ROWS]
        self.books = [_means(np.ascontiguousarray(rest[:, p]), min(CODES, len(rest)), random) for p in self.parts]
        self.apart = np.sqrt(np.maximum(_square_distances(self.centers, self.centers), 1e-12))
        self.radius = math.sqrt(max(0.0, 2 - 2 * similarity))
        most = min(n_rows // 32, BLOCK_NUMBERS // self.dimension)
        self.block_rows = max(BLOCK_ROWS, most)
        n_groups = int(min(max(1, -(-n_rows // max(GROUP_ROWS, most))), k))
        heads = _means(self.centers, n_groups, random)
        self.group = np.unique(_nearest(self.centers, heads)[0], return_inverse=True)[1]
        self.n_groups = int(self.group.max()) + 1

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home cell of each vector, and a table of the cells whose border is near, its own among them."""
        d = _square_distances(x, self.centers)
        home = d.argmin(axis=1)
        border = (d - d[np.arange(len(x)), home][:, None]) / (2 * self.apart[home])
        near = border <= self.radius + SLACK
        return home, near

    def near_groups(self, near: np.ndarray) -> np.ndarray:
        """A table of the groups with a near cell."""
        return np.stack([near[:, self.group == g].any(axis=1) for g in range(self.n_groups)], axis=1)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes leave out."""
        rest = x - self.centers[home]
        codes, lost = np.empty((len(x), len(self.parts)), np.uint8), np.zeros(len(x))
        for m, (part, book) in enumerate(zip(self.parts, self.books)):
            codes[:, m], d = _nearest(np.ascontiguousarray(rest[:, part]), book)
            lost += d
        return codes, np.sqrt(lost)

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for, looked up part by part."""
        y = self.centers[cell]
        for m, (part, book) in enumerate(zip(self.parts, self.books)):
            y[:, part] += book[codes[:, m]]
        return y


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _homes(index: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The home group of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                cell, _ = index.value.place(unit(_matrix(whole.slice(at, 2048).column("embedding"))))
                yield pa.RecordBatch.from_arrays([pa.array(index.value.group[cell].astype(np.int32))], ["part"])

    return run


CODED = "part int, block int, asks boolean, cids binary, cells binary, codes binary, lost binary, vectors binary"


def _sender(index: Broadcast, blocks: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs of vectors for their own blocks, and packs of codes as questions to others.

    Of two groups one asks the other, in turns; in a group a block asks the later ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = unit(_matrix(batch.column("embedding")))
                cell, near = index.value.place(x)
                codes, lost = index.value.encode(x, cell)
                home, near = index.value.group[cell], index.value.near_groups(near)
                n_blocks, n = blocks.value, near.shape[1]
                cid = batch.column("cid").to_numpy()
                own = (cid.view(np.uint64) % n_blocks[home].astype(np.uint64)).astype(np.int64)
                ahead = (np.arange(n)[None] - home[:, None]) % n
                near &= (ahead > 0) & ((2 * ahead < n) | ((2 * ahead == n) & (np.arange(n)[None] > home[:, None])))
                columns = [
                    cid,
                    cell.astype(np.uint16),
                    codes,
                    lost.astype(np.float32),
                    x.astype(np.float32),
                ]
                rows: list[tuple] = []

                def pack(part: int, block: int, asks: bool, chosen: np.ndarray) -> None:
                    given = columns[:4] if asks else columns
                    step = max(1, PACK // sum(c[:1].nbytes for c in given))
                    for k in range(0, len(chosen), step):
                        cut = [c[chosen[k : k + step]].tobytes() for c in given]
                        rows.append((part, block, asks, *cut, *[None] * (5 - len(cut))))

                for part in range(n):
                    inside, asking = home == part, np.flatnonzero(near[:, part])
                    for block in range(int(n_blocks[part])):
                        pack(part, block, False, np.flatnonzero(inside & (own == block)))
                        pack(part, block, True, np.concatenate([asking, np.flatnonzero(inside & (own < block))]))
                types = [pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5]
                names = ["part", "block", "asks", "cids", "cells", "codes", "lost", "vectors"]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _by_block(make: Callable, index: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of ``part``, ``block``, ``asks`` go to a ``make`` per block: first its own, then those that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "block", "asks")])
            ends = [*(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip([0, *ends[:-1]], ends):
                if now != (key[0, i], key[1, i]):
                    if block is not None:
                        yield from block.close()
                    now = key[0, i], key[1, i]
                    block = make(index.value, *now)
                if key[2, i]:
                    yield from block.answer(batch.slice(i, j - i))
                else:
                    block.add(batch.slice(i, j - i))
        if block is not None:
            yield from block.close()

    return run


MAYBE = "part int, block int, asks boolean, cid bigint"


class _Finder:
    """Which vectors of a block, and of those that ask, may be in a link, by the codes of one of the two."""

    def __init__(self, index: Index, part: int, block: int):
        self.index, self.at = index, (int(part), int(block))
        self.packs: list[pa.RecordBatch] = []
        self.columns: np.ndarray | None = None

    def _read(self, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """Ids, decoded vectors and what the product must reach, for runs of packed rows."""
        ix, packs = self.index, [rows.column(c).to_pylist() for c in ("cids", "cells", "codes", "lost")]
        step = max(1, AT_ONCE // max(len(self.cid), ix.dimension))
        cid, cell, codes, lost = (
            np.frombuffer(b"".join(p), t) for p, t in zip(packs, (np.int64, np.uint16, np.uint8, np.float32))
        )
        codes = codes.reshape(len(cid), -1)
        for k in range(0, len(cid), step):
            y = ix.decoded(cell[k : k + step], codes[k : k + step])
            reach = (1 + np.einsum("ij,ij->i", y, y) - (ix.radius + lost[k : k + step].astype(np.float64)) ** 2) / 2
            yield k, cid[k : k + step], np.column_stack([y, SINGLE_SLACK - reach]).astype(np.float32)

    def add(self, rows: pa.RecordBatch) -> None:
        self.packs.append(rows)

    def _begin(self) -> None:
        if self.columns is not None:
            return
        cids = [c for rows in self.packs for c in rows.column("cids").to_pylist()]
        self.cid = np.frombuffer(b"".join(cids), np.int64)
        self.hit = np.zeros(len(self.cid), bool)
        self.columns = np.ones((self.index.dimension + 1, len(self.cid)), np.float32)
        at = 0
        for rows in self.packs:
            for v in rows.column("vectors"):
                x = np.frombuffer(v.as_buffer(), np.float32).reshape(-1, self.index.dimension)
                self.columns[:-1, at : at + len(x)] = x.T
                at += len(x)
        at = 0
        for rows in self.packs:
            for k, cid, y in self._read(rows):
                reached = y @ self.columns
                i = np.arange(len(cid))
                reached[i, at + k + i] = -1
                self._mark(reached)
            at += k + len(cid)
        self.packs = []

    def _mark(self, reached: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(reached.max(axis=1) >= 0) if reached.size else np.empty(0, np.int64)
        if len(near):
            self.hit |= (reached[near] >= 0).any(axis=0)
        return near

    def _said(self, cid: np.ndarray, asks: bool) -> Iterator[pa.RecordBatch]:
        if len(cid):
            same = [pa.array(np.full(len(cid), x, np.int32)) for x in self.at]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(np.full(len(cid), asks)), pa.array(cid)], ["part", "block", "asks", "cid"]
            )

    def answer(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self._begin()
        if len(self.cid):
            for _, cid, y in self._read(rows):
                yield from self._said(cid[self._mark(y @ self.columns)], True)

    def close(self) -> Iterator[pa.RecordBatch]:
        self._begin()
        yield from self._said(self.cid[self.hit], False)


class _Searcher:
    """Links of a block's vectors with each other and with those that ask."""

    def __init__(self, index: Index, part: int, block: int):
        self.index = index
        self.given: list[tuple[np.ndarray, ...]] | None = []

    def add(self, rows: pa.RecordBatch) -> None:
        cid, w = rows.column("cid").to_numpy(), rows.column("w").to_numpy()
        self.given.append((cid, w, unit(_matrix(rows.column("embedding")))))

    def _begin(self) -> None:
        if self.given is None:
            return
        ix = self.index
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, ix.dimension)))
        self.cid, self.w, self.x = map(np.concatenate, zip(*[none, *self.given]))
        self.given = None
        self.links = np.zeros(len(self.cid), np.int64)
        self.forest = np.empty(0, np.int64), np.empty(0, np.int64)
        cell = np.empty(len(self.x), np.int64)
        for at in range(0, len(self.x), 2048):
            cell[at : at + 2048] = ix.place(self.x[at : at + 2048])[0]
        codes, lost = ix.encode(self.x, cell)
        # A vector is no nearer than its code's distance without what the code leaves out.
        self.limit = (ix.radius + lost) ** 2 + SLACK
        self.cells = {c: np.flatnonzero(cell == c) for c in np.unique(cell).tolist()}
        self.decoded = ix.decoded(cell, codes)
        for at in range(0, len(self.x), 2048):
            self._links(self.x[at : at + 2048], self.w[at : at + 2048], np.arange(at, min(at + 2048, len(self.x))), cell)

    def _links(self, x: np.ndarray, w: np.ndarray, place: np.ndarray, cell: np.ndarray | None) -> np.ndarray:
        """Numbers of links of ``x``; with ``cell`` they are the block's own, and each pair is taken once."""
        ix = self.index
        links, found = np.zeros(len(x), np.int64), [self.forest]
        near = ix.place(x)[1]
        for c, own in self.cells.items():
            asking = np.flatnonzero(near[:, c])
            step = max(1, AT_ONCE // len(own))
            for at in range(0, len(asking), step):
                q = asking[at : at + step]
                i, j = np.nonzero(_square_distances(x[q], self.decoded[own]) <= self.limit[own][None])
                i, j = q[i], own[j]
                if cell is not None:
                    # Two of the same block by their cells, then by their places.
                    later = (cell[place[i]] < c) | ((cell[place[i]] == c) & (place[i] > j))
                    i, j = i[later], j[later]
                most = max(1, AT_ONCE // ix.dimension)
                for k in range(0, len(i), most):
                    a, b = i[k : k + most], j[k : k + most]
                    hit = np.einsum("ij,ij->i", x[a], self.x[b]) >= ix.similarity
                    a, b = a[hit], b[hit]
                    np.add.at(links, a, self.w[b])
                    np.add.at(self.links, b, w[a])
                    found.append(forest(place[a], b))
        u, v = forest(*map(np.concatenate, zip(*found)))
        if cell is not None:
            self.links[place] += links
        self.forest = u[u < len(self.x)], v[u < len(self.x)]
        self.roots = u, v
        return links

    def _said(self, cid: np.ndarray, links: np.ndarray, first: int) -> pa.RecordBatch:
        root = np.arange(first + len(cid))
        u, v = self.roots if first else self.forest
        root[u] = v
        n = np.flatnonzero(links)
        # The smallest place of those linked is in the block.
        own = root[first + n]
        return pa.RecordBatch.from_arrays([pa.array(cid[n]), pa.array(links[n]), pa.array(self.cid[own])], ["cid", "n", "root"])

    def answer(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self._begin()
        for at in range(0, rows.num_rows if len(self.cid) else 0, 2048):
            part = rows.slice(at, 2048)
            x, cid, w = unit(_matrix(part.column("embedding"))), part.column("cid").to_numpy(), part.column("w").to_numpy()
            links = self._links(x, w, len(self.x) + np.arange(len(x)), None)
            yield self._said(cid, links, len(self.x))

    def close(self) -> Iterator[pa.RecordBatch]:
        self._begin()
        yield self._said(self.cid, self.links, 0)


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    spark = vectors.sparkSession
    ship_package(spark)
    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select("vec_id", "embedding")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    ) & F.exists("embedding", lambda v: v != 0)
    sizes = rows.where(usable).groupBy(F.size("embedding").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), "size").limit(1).collect()
    dimension = most[0]["size"] if most else 0
    usable &= F.size("embedding") == dimension
    # Adding zero turns negative zeros into positive ones.
    plain = F.transform("embedding", lambda v: v + F.lit(0).cast(kind[6:-1]))
    marked = rows.withColumn("embedding", F.when(F.coalesce(usable, F.lit(False)), plain))
    marked = marked.withColumn("cid", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    classes = marked.where("cid IS NOT NULL").groupBy("cid").agg(
        F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count("*").alias("w")
    )
    classes = materialize(classes, "vector-classes")
    n = classes.count()
    if n:
        taken = min(SAMPLE, max(256, SAMPLE_NUMBERS // dimension))
        sample = classes.orderBy("cid").limit(taken).select("embedding").toArrow()
        fitted = Index(_matrix(sample.column("embedding").combine_chunks()), n, similarity)
        index = spark.sparkContext.broadcast(fitted)
        given = classes.select("cid", "w", "embedding")
        cells = given.mapInArrow(_homes(index), "part int").groupBy("part").count()
        # One row per group, at most ``MAX_CELLS``.
        n_blocks = np.ones(fitted.n_groups, np.int64)
        for x in cells.collect():
            n_blocks[x["part"]] = -(-x["count"] // fitted.block_rows)
        blocks = spark.sparkContext.broadcast(n_blocks)
        # More tasks than blocks, so that few tasks have two.
        tasks, order = 4 * int(n_blocks.sum()), ("part", "block")
        coded = given.mapInArrow(_sender(index, blocks), CODED).repartition(tasks, *order)
        maybe = coded.sortWithinPartitions(*order, "asks").mapInArrow(_by_block(_Finder, index), MAYBE)
        maybe = materialize(maybe, "maybe-linked")
        wanted = filters.marked(given, F.col("cid"), filters.bits(maybe, F.col("cid"))).where("maybe").drop("maybe")
        routed = wanted.join(maybe, "cid").repartition(tasks, *order).sortWithinPartitions(*order, "asks")
        found = routed.mapInArrow(_by_block(_Searcher, index), "cid bigint, n bigint, root bigint")
        found = materialize(found, "vector-links")
        edges = found.select("cid", "root").where("cid <> root")
        counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
        roots = components(edges, "cid", "root").withColumnRenamed("node", "cid")
        rooted = classes.select("cid", "first_id", "w").join(counts, "cid", "left").join(roots, "cid", "left")
    else:
        rooted = classes.select("cid", "first_id", "w").withColumns({"n": F.lit(0), "root": F.col("cid")})
    rooted = rooted.withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = materialize(
        rooted.join(least, "root").select(
            "cid", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id"
        ),
        "vector-components",
    )
    joined = marked.select("vec_id", "cid").join(of_class, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
