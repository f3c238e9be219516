"""Connected components: a numpy forest inside a task, alternating stars across the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import drop, store


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges that connect what the edges (a, b) connect: each node to the smallest of its component."""
    if not len(a):
        return a, b
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = local_roots(len(nodes), code[: len(a)], code[len(a) :])
    i = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[i], nodes[root[i]]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst): the smallest node of its component.

    Large and small stars alternate until the edges stay as they are: every node then points at its root. Each
    round is one shuffle by source and one by target, with sums and joins only, so no neighbourhood is collected
    in one place, and its result is a stored table.
    """
    now = store(edges.where("src <> dst").selectExpr("greatest(src, dst) AS src", "least(src, dst) AS dst").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node points at the node's least neighbour or itself
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        # small star: a node and its smaller neighbours point at the least of them
        large = store(large, "edges-large")
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        new = store(small.union(low.select("src", F.col("low").alias("dst"))).distinct(), "edges")
        drop(large)
        drop(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        state = tuple(seen)
    raise RuntimeError("connected components did not settle")
