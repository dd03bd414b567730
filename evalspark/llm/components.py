"""Connected components of a graph given as a table of edges, and the forest of a block of pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.session import materialize

MAX_ROUNDS = 64


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node that it is connected with, for every node of an edge.

    Each round joins every node to its smallest neighbour, follows such pointers a few steps, and
    replaces the edges by those between the nodes pointed at, so the graph shrinks to nothing in about as many
    rounds as the logarithm of its longest path. Every round is written to shared storage. Minima
    combine before the shuffle and the joins have one row per node on one side, so a node with very
    many edges is no single task's work. Nulls and loops link nothing; no edges give an empty table.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    live = materialize(live, "edges")
    label: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        parent = materialize(parent, "parents")
        for _ in range(2):
            above = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(above, "p").select("a", F.col("pp").alias("p"))
        parent = materialize(parent, "parents")
        if label is None:
            label = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("a").alias("root"), F.col("p").alias("next"))
            label = label.join(step, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")
            )
        label = materialize(label, "labels")
        to_a = parent.select("a", F.col("p").alias("pa"))
        to_b = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        live = live.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        live = materialize(
            live.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges"
        )
    else:
        raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} rounds")
    if label is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each value in the pairs to the smallest value connected with it, loops left out."""
    if not len(u):
        return u, v
    values, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        # Hook the roots of both ends, then shorten the paths.
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    own = root != np.arange(len(values))
    return values[own], values[root[own]]
