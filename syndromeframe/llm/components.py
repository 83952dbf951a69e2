"""Connected components of edge tables by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for all nodes that aren't the least of their component, from int64 links."""
    if not len(a):
        return a, b
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = idx[: len(a)], idx[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _both_ways(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _signature(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in an edge (u, v); root is the least node of its component.

    Large-star links each node's larger neighbours to its least neighbour, small-star its smaller ones; both
    keep connectivity and end in stars after about log(n) rounds. Minima are pre-aggregated before they are shuffled
    and stored before they are joined, so that both sides of a join are plain shuffles, in which Spark splits the
    partitions that hubs swell. Nulls are no nodes; loops and repeated edges change nothing; no edge gives no row.
    Tables of earlier rounds are deleted.
    """
    e = common.stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        sym = _both_ways(e)
        least = common.stored(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = common.stored(sym.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars")
        lower = common.stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = common.stored(small.union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _signature(new)
        for old in (e, least, large, lower):
            common.discard(old)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v"))).distinct()
