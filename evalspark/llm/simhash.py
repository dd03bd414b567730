"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles. Distinct
fingerprints are dealt to shards by a vantage-point tree: each node has a point and a radius, and a
fingerprint goes inside or outside by its Hamming distance from the point. Two fingerprints at most ``r`` bits
apart differ by at most ``r`` in that distance, so one that stands within ``r`` of the boundary is also sent, as a
question, to the other side. Within a shard the same splitting goes on until blocks are small enough to compare.
No pair within ``r`` is missed. A shard gives a spanning forest of the links it found, never all pairs.

The tree is fitted on a bounded sample of the fingerprints (``SAMPLE``); all fingerprints go through it,
and its depth follows their number. Only the sample reaches the driver.

Defined cases: null and empty texts have fingerprint zero, linked like any other; a text with fewer words
than a shingle has one shingle, the whole sequence; copies share a fingerprint and are linked
through it; a null id stays a row; repeated ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.components import components, forest
from evalspark.llm.filters import packed, unpacked, without_rows
from evalspark.llm.line_dedup import similar_links, text_shingles
from evalspark.session import materialize, ship_package

SEED = 42
SAMPLE = 1 << 14
SHARD_ROWS = 1 << 12
BLOCK = 1 << 20


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of a text, A-Z in lower case, words cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1]
    spans = zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())
    return np.fromiter([digest(joined[i:j], SEED) for i, j in spans], np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    n = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = np.ascontiguousarray(hashes[at : at + (1 << 15)], ">u8")
        n += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * n > len(hashes)).tobytes(), "big")


def _fingerprinter(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            marks = [majority(shingle_hashes(texts[i].as_py(), width)) for i in range(len(texts))]
            marks = np.array(marks, np.uint64).view(np.int64)
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(marks)], [*names, "fp"])

    return run


def fingerprints(documents: DataFrame, width: int = 3, id_column: str = "doc_id") -> DataFrame:
    """The id and ``fp``, the fingerprint's 64 bits as a long, of every document."""
    ship_package(documents.sparkSession)
    kind = dict(documents.dtypes)[id_column]
    return documents.select(id_column, "text").mapInArrow(
        _fingerprinter(width), f"`{id_column}` {kind}, fp bigint"
    )


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int16)


class Tree:
    """A vantage-point tree as arrays; node i has the children 2i + 1 (inside) and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        n = (1 << depth) - 1
        # Beyond the sample's reach a point is made from its number, with the usual distance of strangers.
        self.point = np.array([xxhash.xxh64_intdigest(i.to_bytes(8), SEED) for i in range(n)], np.uint64)
        self.radius = np.full(n, 31, np.int16)
        rows = {0: sample}
        for i in range(n):
            own = rows.pop(i, sample[:0])
            if len(own) < 16:
                continue
            self.point[i] = own[0]
            d = _distance(own, own[0])
            self.radius[i] = np.sort(d)[(len(d) - 1) // 2]
            inside = d <= self.radius[i]
            rows[2 * i + 1], rows[2 * i + 2] = own[inside], own[~inside]

    def route(self, fps: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, leaves and whether at home, of fingerprints and of the questions they ask.

        Of two that part at a node the inner one asks outside; questions go wherever they may be answered.
        """
        row = np.arange(len(fps))
        node = np.zeros(len(fps), np.int64)
        home = np.ones(len(fps), bool)
        for _ in range(self.depth):
            d, mu = _distance(fps[row], self.point[node]), self.radius[node]
            inside = np.where(home, d <= mu, d - r <= mu)
            outside = np.where(home, d > mu, d + r > mu)
            asks = home & inside & (d + r > mu)
            row = np.concatenate([row[inside], row[outside], row[asks]])
            home = np.concatenate([home[inside], home[outside], np.zeros(asks.sum(), bool)])
            node = np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2, 2 * node[asks] + 2])
        return row, node, home


def _links(homes: np.ndarray, asking: np.ndarray, r: int, level: int = 0) -> Iterator[tuple]:
    """Pairs at most ``r`` apart within ``homes`` and between it and ``asking``, by blocks."""
    if not len(homes) or len(homes) + len(asking) < 2:
        return
    if len(homes) * (len(homes) + len(asking)) > BLOCK and level < 12:
        d = _distance(homes, homes[0])
        mu = np.sort(d)[(len(d) - 1) // 2]
        inside = d <= mu
        if inside.any() and not inside.all():
            q = _distance(asking, homes[0])
            near = homes[inside & (d + r > mu)]
            yield from _links(homes[inside], asking[q - r <= mu], r, level + 1)
            yield from _links(
                homes[~inside], np.concatenate([asking[q + r > mu], near]), r, level + 1
            )
            return
    everything = np.concatenate([homes, asking])
    step = max(1, BLOCK // len(everything))
    for at in range(0, len(homes), step):
        i, j = np.nonzero(np.bitwise_count(homes[at : at + step, None] ^ everything[None, at:]) <= r)
        other = i < j
        if other.any():
            yield forest(homes[at + i[other]], everything[at + j[other]])


def _linker(r: int) -> Callable[[pa.Table], pa.Table]:
    def run(shard: pa.Table) -> pa.Table:
        fps = shard.column("fp").to_numpy().view(np.uint64)
        home = shard.column("home").to_numpy(zero_copy_only=False)
        found = list(_links(np.unique(fps[home]), np.unique(fps[~home]), r))
        u = np.concatenate([np.empty(0, np.uint64), *[x for x, _ in found]]).view(np.int64)
        v = np.concatenate([np.empty(0, np.uint64), *[y for _, y in found]]).view(np.int64)
        u, v = forest(u, v)
        return pa.table({"a": u, "b": v})

    return run


def fingerprint_links(fps: DataFrame, r: int, sample_rows: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges between distinct fingerprints ``fp`` that connect all pairs at most ``r`` bits apart.

    ``fps`` holds each fingerprint once and is read three times.
    """
    spark = fps.sparkSession
    ship_package(spark)
    n = fps.count()
    taken = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()
    sample = np.array([x["fp"] for x in taken], np.int64).view(np.uint64)
    tree = Tree(sample, max(0, math.ceil(math.log2(max(1, n / shard_rows)))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(own), 1 << 12):
                part = own[at : at + (1 << 12)]
                row, leaf, home = tree.route(part, r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), pa.array(part[row].view(np.int64)), pa.array(home)], ["leaf", "fp", "home"]
                )

    routed = fps.select("fp").mapInArrow(route, "leaf bigint, fp bigint, home boolean")
    return routed.groupBy("leaf").applyInArrow(_linker(r), "a bigint, b bigint")


def simhash_components(
    documents: DataFrame, width: int = 3, radius: int = 2, id_column: str = "doc_id"
) -> DataFrame:
    """One row per document: id, ``fp``, and ``component_id``, the smallest id it is connected with."""
    marked = materialize(fingerprints(documents, width, id_column), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min(id_column).alias("first_id")), "classes")
    roots = components(fingerprint_links(classes, radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = materialize(rooted.join(least, "root").select("fp", "component_id"), "components")
    return marked.join(of_class, "fp").select(id_column, "fp", "component_id")


def drop_near_duplicates(documents: DataFrame, width: int = 5, radius: int = 3) -> DataFrame:
    """The first row, in the order of the stored table, of every group of linked documents.

    Fingerprints find near copies only; texts whose sets of shingles have a Jaccard similarity of at least 4/5 are
    linked as well, by the exact join of ``line_dedup`` over shingles. Groups are connected by links of both kinds.
    """
    rows = packed(documents)
    texts = rows.select("row", F.col("own.text").alias("text"))
    found = simhash_components(texts, width, radius, "row").where("row <> component_id")
    links = similar_links(texts, found.select(F.col("row").alias("a"), F.col("component_id").alias("b")), text_shingles(width))
    gone = components(links).where("node <> root").select(F.col("node").alias("row"))
    return without_rows(rows, materialize(gone, "near-duplicates")).select(*unpacked(documents.columns))
