"""Decoding of lattices too large for one task: growth as a loop of joins, peeling cluster by cluster.

Tiling is partitioning, not semantics: nodes are dealt by (shot, tile), and an edge between tiles is an edge
like any other. Labels, growth and correction are those of the kernel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grids import Grid
from ..plans.store import stored
from . import kernel, lattice
from .clusters import largest_labels
from .lattice import GraphAdjacency


def grow(defects: DataFrame, edges: DataFrame, rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(nodes, full): nodes (shot_id, node, label, odd, outer) of all clusters and full edges (shot_id, edge_id, u, v).

    Every round, clusters of odd parity without a boundary add half an edge to all edges at their nodes. Support
    and nodes are stored in each round; frozen clusters cost nothing but their rows.
    """
    ends = edges.select("edge_id", "u", "v", F.explode(F.array_compact(F.array("u", "v"))).alias("node"))
    nodes = stored(defects.select("shot_id", "node", F.col("node").alias("label"), F.lit(1).alias("odd"), F.lit(False).alias("outer")))
    support = nodes.sparkSession.createDataFrame([], "shot_id bigint, edge_id bigint, u bigint, v bigint, s int")
    for _ in range(rounds):
        state = nodes.groupBy("shot_id", "label").agg((F.sum("odd") % 2 == 1).alias("is_odd"), F.max("outer").alias("at_boundary"))
        active = nodes.join(state.filter("is_odd AND NOT at_boundary").select("shot_id", "label"), ["shot_id", "label"], "left_semi")
        step = active.select("shot_id", "node").join(ends, "node").groupBy("shot_id", "edge_id", "u", "v").agg(F.count("*").cast("int").alias("more"))
        both = support.join(step.withColumnRenamed("u", "su").withColumnRenamed("v", "sv"), ["shot_id", "edge_id"], "full")
        now = stored(both.select("shot_id", "edge_id", F.coalesce("u", "su").alias("u"), F.coalesce("v", "sv").alias("v"), F.coalesce("s", F.lit(0)).alias("before"), F.least(F.lit(2), F.coalesce("s", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("s")))
        if not now.filter("s > before").limit(1).count():
            break
        new = now.filter("s = 2 AND before < 2").select("shot_id", "u", "v")
        support = now.select("shot_id", "edge_id", "u", "v", "s")
        touched = new.filter("v IS NULL").select("shot_id", F.col("u").alias("node")).distinct().withColumn("hit", F.lit(True))
        fresh = new.select("shot_id", F.explode(F.array_compact(F.array("u", "v"))).alias("node")).distinct().join(nodes.select("shot_id", "node"), ["shot_id", "node"], "left_anti")
        grown = nodes.unionByName(fresh.select("shot_id", "node", F.col("node").alias("label"), F.lit(0).alias("odd"), F.lit(False).alias("outer")))
        grown = stored(grown.join(touched, ["shot_id", "node"], "left").select("shot_id", "node", "label", "odd", (F.col("outer") | F.coalesce("hit", F.lit(False))).alias("outer")))
        # merge the labels that new edges join; the largest node names a cluster
        of = grown.select("shot_id", "node", "label")
        joined = new.filter("v IS NOT NULL").join(of.select("shot_id", F.col("node").alias("u"), F.col("label").alias("lu")), ["shot_id", "u"]).join(of.select("shot_id", F.col("node").alias("v"), F.col("label").alias("lv")), ["shot_id", "v"])
        merges = stored(joined.filter("lu <> lv").select("shot_id", F.col("lu").alias("u"), F.col("lv").alias("v")).distinct())
        if merges.limit(1).count():
            names = largest_labels(merges, ["shot_id"]).select("shot_id", F.col("node").alias("label"), F.col("label").alias("name"))
            grown = stored(grown.join(names, ["shot_id", "label"], "left").select("shot_id", "node", F.coalesce("name", "label").alias("label"), "odd", "outer"))
        nodes = grown
    return nodes, support.filter("s = 2").select("shot_id", "edge_id", "u", "v")


def _peel_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Correction edges of one cluster: rows with an edge_id are its full edges, the others its defects."""
    edge = np.array([x is not None for x in table.column("edge_id").to_pylist()], bool)
    u = table.column("u").to_numpy(zero_copy_only=False)
    v = np.array([-1 if x is None else x for x in table.column("v").to_pylist()], np.int64)
    ids = np.array([-1 if x is None else x for x in table.column("edge_id").to_pylist()], np.int64)
    order = np.argsort(ids[edge])
    empty = pa.table({"shot_id": pa.array([], pa.int64()), "u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    if not edge.any() or edge.all():
        return empty
    adj = GraphAdjacency(u[edge][order], v[edge][order])
    n, m = len(adj.public), len(adj.u)
    parent = np.full(n, n - 1)  # the largest node is the root
    _, chosen, _, _ = kernel._peel(adj, np.arange(m), np.append(np.full(m, kernel.FULL), kernel.GONE), parent, np.arange(n), adj.to_dense(u[~edge]))
    far = adj.v[chosen]
    return pa.table({"shot_id": pa.array([key[0].as_py()] * len(chosen), pa.int64()), "u": pa.array(adj.public[adj.u[chosen]]), "v": pa.array(adj.public[np.maximum(far, 0)], mask=far < 0)})


def corrections(defects: DataFrame, spark: SparkSession, grid: Grid) -> DataFrame:
    """(shot_id, u, v) for distinct defects (shot_id, node) of one or more shots on a lattice of any size.

    The lattice's edges are a relation of their own that is joined, not broadcast by hand; a cluster, whose size
    follows the noise and not the lattice, is peeled by one task.
    """
    edges = stored(lattice.edges(spark, grid))
    nodes, full = grow(defects.select("shot_id", "node"), edges)
    of = nodes.select("shot_id", F.col("node").alias("u"), "label")
    rows = full.join(of, ["shot_id", "u"]).select("shot_id", "label", "edge_id", "u", "v")
    lone = nodes.filter("odd = 1").select("shot_id", "label", F.lit(None).cast("bigint").alias("edge_id"), F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"))
    return rows.unionByName(lone).groupBy("shot_id", "label").applyInArrow(_peel_group, "shot_id bigint, u bigint, v bigint")
