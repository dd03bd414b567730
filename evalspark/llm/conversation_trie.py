"""Prefix trie of conversations, by collapsing whole sequences.

``ordered_turns`` gives every turn its place. The turns, as digests of role and text, are sorted by range, so a
conversation of any length is dealt to several tasks, and the few conversations that go on in a later range are
continued by the number of turns before it. ``rebuilt_turns`` makes each conversation start with the first turns of
another one. ``prefix_trie`` then

* sums position-bound hashes of the turns, first within blocks of a conversation, then across blocks, so that a prefix
  has a 128-bit key and a conversation of many turns needs no task of its own;
* groups conversations of the same whole sequence into one weighted sequence, with the list of those that end there;
* finds the sequences that are no proper prefix of another one, the leaves, by an anti-join of whole sequences with prefixes;
* aggregates the prefixes of the weighted sequences into nodes.

Savings of a subtree are sums over its sequences alone: a node belongs to its smallest member, which owns the end of its
path from some depth on, so a sequence of weight w adds w times its words from the node on, less those of what it owns.

Sums and counts are combined before each shuffle; turns join on (conversation, block). The children of one
parent are looked up by a join on the parent, whose partitions adaptive execution may split; the root's need none.

Defined cases: rows without ``conv_id`` belong to no conversation and are left out; a null turn comes first; rows of the
same turn follow each other in the order of their digests, repeated rows included; a null role or text is empty; an empty
table has no nodes; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import materialize, ship_package

WORD = r"[^\x20\x09-\x0D]+"
# Turns of a conversation that are summed in one go.
BLOCK_TURNS = 4096
# Ids that travel as one row towards their digest.
IDS_A_ROW = 4096
KEY = ["depth", "k1", "k2"]
# The block of the turns that come from another conversation, and that of the root.
HEAD, ROOT = -1, -2


class Trie(NamedTuple):
    """``nodes``, one row each, and ``ends``, one row per conversation with the node at which it ends."""

    nodes: DataFrame
    ends: DataFrame


def turn_digest() -> Column:
    """128 bits of role and text; null is empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row of the sorted partition among those of its conversation, from 0."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
        sizes = np.diff(np.append(starts, len(ids)))
        places = np.arange(len(ids)) - np.repeat(starts, sizes)
        if ids[0] == last:
            places[: sizes[0]] += seen
        last, seen = ids[-1], int(places[-1]) + 1
        parts = pa.array(np.full(len(ids), part, np.int32))
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["conv_id", "key", "words"]).columns, parts, pa.array(places)],
            ["conv_id", "key", "words", "part", "place"],
        )


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (``conv_id``, ``pos`` from 0, ``key``, ``words``) and conversations (``conv_id``, ``n``)."""
    ship_package(conversations.sparkSession)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        turn_digest().alias("key"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    # Stored, as the bounds of the ranges come from a sample and have to be the same for all that follows.
    stored = materialize(
        ranged.mapInArrow(_places, "conv_id long, key binary, words long, part int, place long"), "turns"
    )
    runs = materialize(stored.groupBy("conv_id", "part").agg((F.max("place") + 1).alias("n")), "runs")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation per range goes on from an earlier one.
    continued = runs.withColumn("before", F.sum("n").over(before)).where("before IS NOT NULL").drop("n")
    placed = stored.join(F.broadcast(continued), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "words"
    )
    return placed, runs.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt_turns(conversations: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first h turns of the first one of their family, then go on with their own.

    h is the CRC-32 of the decimal id modulo ``most``; a family's first id is c - c % ``family``. Returns turns (``conv_id``,
    ``block``, ``depth`` from 1, ``key``, ``words``) and conversations (``conv_id``), those without a turn included.
    """
    turns, convs = ordered_turns(conversations)
    conv = F.col("conv_id")
    h = F.crc32(conv.cast("string").cast("binary")) % most
    heads = (
        turns.where((conv % family == 0) & (F.col("pos") < most - 1))
        .groupBy(conv.alias("first"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("turns"))
    )
    none = F.expr("cast(array() as array<struct<pos:bigint,key:binary,words:bigint>>)")
    plans = (
        convs.withColumn("first", conv - conv % family)
        .join(heads, "first", "left")
        .select("conv_id", "n", F.slice(F.coalesce("turns", none), F.lit(1), h.cast("int")).alias("head"))
    )
    plans = materialize(plans, "plans")
    own_head = plans.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.lit(HEAD).cast("long").alias("block"), (F.col("t.pos") + 1).alias("depth"), "t.key", "t.words"
    )
    blocks = plans.select(
        "conv_id",
        F.size("head").cast("long").alias("shared"),
        F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK_TURNS})")).alias("block"),
    )
    tail = (
        turns.where(F.col("pos") >= h)
        .withColumn("block", F.expr(f"pos div {BLOCK_TURNS}"))
        .join(blocks, ["conv_id", "block"])
        .select("conv_id", "block", (F.col("pos") - h + F.col("shared") + 1).alias("depth"), "key", "words")
    )
    return own_head.unionByName(tail), plans.select("conv_id")


def _hashes() -> dict[str, Column]:
    """Four 32-bit numbers of a turn at its depth, whose sums over a prefix are the prefix's key."""
    a = F.xxhash64("depth", "key")
    b = F.xxhash64(F.lit(1), "key", "depth")
    low = F.lit(0xFFFFFFFF).cast("long")
    parts = (a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32))
    return {f"s{i}": x for i, x in enumerate(parts)}


SUMS = ["s0", "s1", "s2", "s3", "total"]


def _key(*sums: Column) -> list[Column]:
    """Two longs from four sums modulo 2^32."""
    low = F.lit(0xFFFFFFFF).cast("long")
    a, b, c, d = (x.bitwiseAND(low) for x in sums)
    return [F.shiftleft(b, 32).bitwiseOR(a).alias("k1"), F.shiftleft(d, 32).bitwiseOR(c).alias("k2")]


def prefix_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of ordered turns (``conv_id``, ``block``, ``depth`` 1, 2, ..., ``key``, ``words``) of ``convs`` (``conv_id``).

    ``block`` cuts the turns of a conversation into runs of bounded length, in the order of their depth. Nodes have their
    key (``depth``, ``k1``, ``k2``), ``turn_key`` (the digest of the last turn), ``words`` of its text, ``conv_id`` (the
    smallest member), ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens``.
    """
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    hashed = turns.withColumns({**_hashes(), "total": F.col("words")})
    summed = materialize(
        hashed.select(
            "conv_id", "block", "depth", "key", "words",
            *[F.col(s).alias(f"own_{s}") for s in SUMS[:4]],
            *[F.sum(s).over(within).alias(s) for s in SUMS],
        ),
        "sums",
    )
    # All sums grow with the depth, so a block's last one is its largest.
    blocks = summed.groupBy("conv_id", "block").agg(F.max("depth").alias("last"), *[F.max(s).alias(s) for s in SUMS])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(
        blocks.select(
            "conv_id", "block", "last", *SUMS, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"b_{s}") for s in SUMS]
        ),
        "blocks",
    )
    wholes = blocks.groupBy("conv_id").agg(F.max("last").alias("depth"), *[F.sum(s).alias(s) for s in SUMS])
    zero = F.lit(0).cast("long")
    wholes = convs.join(wholes, "conv_id", "left").select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in ("depth", "total")],
        *_key(*[F.coalesce(s, zero) for s in SUMS[:4]]),
    )
    wholes = materialize(wholes, "wholes")
    sequences = wholes.groupBy(*KEY).agg(
        F.min("conv_id").alias("first"), F.count("*").alias("weight"), F.max("total").alias("total")
    )
    sequences = materialize(sequences, "sequences")

    of_sequence = sequences.select(F.col("first").alias("conv_id"), "weight", F.col("depth").alias("length"))
    starts = blocks.select("conv_id", "block", *[F.col(f"b_{s}") for s in SUMS]).join(of_sequence, "conv_id")
    to_here = [F.col(s) + F.col(f"b_{s}") for s in SUMS]
    to_parent = [F.col(s) + F.col(f"b_{s}") - F.col(f"own_{s}") for s in SUMS[:4]]
    parent = [c.alias(n) for c, n in zip(_key(*to_parent), ("p1", "p2"))]
    prefixes = summed.join(starts, ["conv_id", "block"]).select(
        "conv_id", "block", "depth", *_key(*to_here[:4]), *parent, "key", "words",
        to_here[4].alias("total"), "weight", "length",
    )
    null = F.lit(None)
    roots = of_sequence.select(
        "conv_id", F.lit(ROOT).cast("long").alias("block"), *[zero.alias(c) for c in KEY],
        null.cast("long").alias("p1"), null.cast("long").alias("p2"), null.cast("binary").alias("key"),
        zero.alias("words"), zero.alias("total"), "weight", "length",
    )
    prefixes = materialize(prefixes.unionByName(roots), "prefixes")

    nodes = prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        *[F.min(c).alias(c) for c in ("p1", "p2", "key", "words", "total")],
        F.max(F.col("length") > F.col("depth")).alias("inner"),
    )
    nodes = materialize(nodes, "nodes")
    leaves = sequences.join(nodes.where("inner").select(*KEY), KEY, "left_anti").select(
        F.col("first").alias("conv_id"), F.lit(1).alias("leaf")
    )
    owned = nodes.groupBy("conv_id").agg(F.min_by(F.col("total") - F.col("words"), "depth").alias("unowned"))
    facts = (
        sequences.select(F.col("first").alias("conv_id"), F.col("total").alias("whole"))
        .join(owned, "conv_id", "left")
        .join(leaves, "conv_id", "left")
        .select(
            "conv_id", "whole", F.coalesce("unowned", "whole").alias("unowned"), F.coalesce("leaf", F.lit(0)).alias("leaf")
        )
    )
    parts = blocks.select("conv_id", "block").unionByName(
        sequences.select(F.col("first").alias("conv_id"), F.lit(ROOT).cast("long").alias("block"))
    )
    above = F.col("total") - F.col("words")
    saved = F.col("weight") * (F.col("whole") - above) - (F.col("whole") - F.greatest(above, F.col("unowned")))
    subtrees = (
        prefixes.join(parts.join(facts, "conv_id"), ["conv_id", "block"])
        .groupBy(*KEY)
        .agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    )
    up = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").select(up, F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = children.groupBy(*KEY).agg(F.count("*").alias("n_children"))
    counted = nodes.join(subtrees, KEY).join(children, KEY, "left")

    # The root is one row; every other parent is looked up by its key.
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("root_conv_id"), F.lit(1).cast("long").alias("depth"))
    parents = nodes.where("depth > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("k1").alias("p1"),
        F.col("k2").alias("p2"),
        F.col("conv_id").alias("own_parent"),
    )
    low = counted.where("depth <= 1").join(F.broadcast(root), "depth", "left")
    high = counted.where("depth > 1").join(parents, ["depth", "p1", "p2"], "left")
    columns = [
        *KEY, F.col("key").alias("turn_key"), "words", "conv_id", "parent_conv_id", "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
    ]
    both = low.withColumnRenamed("root_conv_id", "parent_conv_id").select(*columns).unionByName(
        high.withColumnRenamed("own_parent", "parent_conv_id").select(*columns)
    )
    return Trie(both, wholes.select(*KEY, "conv_id"))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of their last turn, null at the root."""
    texts = conversations.select(
        turn_digest().alias("turn_key"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    return nodes.join(texts.dropDuplicates(["turn_key"]), "turn_key", "left")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) to rows of up to ``IDS_A_ROW`` ids of one key, as text."""
    for batch in batches:
        table = [batch.column(c).to_numpy() for c in KEY]
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        new = np.any([np.diff(c) != 0 for c in table], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(ids)]])
        cuts = sorted({*starts.tolist(), *[i for a, b in zip(starts, starts[1:]) for i in range(a, b, IDS_A_ROW)]})
        text = [str(i) for i in ids.tolist()]
        rows = [",".join(text[a:b]) for a, b in zip(cuts, cuts[1:])]
        at = np.array(cuts[:-1])
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c[at]) for c in table], pa.array(ids[at]), pa.array(rows)], [*KEY, "conv_id", "ids"]
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a key, in order, to the digest of all of them with commas between."""
    key, whole = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple] = []
        rows = zip(*[batch.column(c).to_pylist() for c in [*KEY, "ids"]])
        for *own, ids in rows:
            if own != key:
                if key is not None:
                    done.append((*key, whole.hexdigest()))
                key, whole = own, hashlib.sha256()
            else:
                whole.update(b",")
            whole.update(ids.encode())
        if done:
            yield _digests(done)
    if key is not None:
        yield _digests([(*key, whole.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    *keys, digests = zip(*rows)
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in keys], pa.array(digests)], [*KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """Per node at which conversations end: SHA-256 of their ids, ascending and joined by commas.

    The ids of a node are sorted by range, so many of them are dealt to several tasks, and pass through the hash, which can
    only be taken in order, as rows of many ids: one at a time is in memory.
    """
    ship_package(ends.sparkSession)
    long = "depth long, k1 long, k2 long"
    ranged = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = ranged.mapInArrow(_joined, f"{long}, conv_id long, ids string")
    grouped = joined.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return grouped.mapInArrow(_hashed, f"{long}, ends_sha256 string")
