"""Connected components: per shot in arrays, and of any edge relation in a loop of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.grids import Grid
from ..plans.store import discard, stored
from .kernel import _find, _union


def nearby_labels(defects: DataFrame, grid: Grid, reach: int = 2) -> DataFrame:
    """(shot_id, node, root): defects of a shot linked at L1 distance <= reach; the root is the largest node.

    A shot has at most as many defects as the lattice has nodes, so it fits a task.
    """

    def label(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        y_bits = grid.stride_y
        x, y, t = node % y_bits, node // y_bits % y_bits, node // grid.stride_z
        parent, active, k = np.arange(len(key)), np.arange(len(key)), 1
        while True:
            active = active[active + k < len(key)]
            active = active[key[active] == key[active + k]]
            if not len(active):
                break
            b = active + k
            near = np.abs(x[active] - x[b]) + np.abs(y[active] - y[b]) + np.abs(t[active] - t[b]) <= reach
            _union(parent, active[near], b[near])
            k += 1
        root = _find(parent, np.arange(len(key))) if len(key) else parent
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(node[root])], ["shot_id", "node", "root"])

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([a, batch.column(k).to_numpy()]) for k, a in enumerate(held)]
            if len(held[0]) and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield label(held[0][:cut], held[1][:cut])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield label(*held)

    return defects.select("shot_id", "node").repartition("shot_id").sortWithinPartitions("shot_id").mapInArrow(run, "shot_id bigint, node bigint, root bigint")


def largest_labels(edges: DataFrame, keys: list[str], rounds: int = 64) -> DataFrame:
    """(keys.., node, label) of the nodes of edges (keys.., u, v): label is the largest node of the component.

    Each round takes the neighbours' largest label and then the label's own label; stored tables cut the lineage.
    """
    sym = stored(edges.select(*keys, "u", "v").unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = sym.groupBy(*keys, F.col("u").alias("node")).agg(F.greatest(F.max("v"), F.first("u")).alias("label"))
    last = None
    for _ in range(rounds):
        near = sym.join(labels.select(*keys, F.col("node").alias("v"), "label"), [*keys, "v"]).groupBy(*keys, F.col("u").alias("node")).agg(F.max("label").alias("far"))
        up = labels.join(near, [*keys, "node"]).select(*keys, "node", "label", F.greatest("label", "far").alias("up"))
        jump = up.select(*keys, F.col("node").alias("up"), F.col("up").alias("top"))
        new = stored(up.join(jump, [*keys, "up"], "left").select(*keys, "node", "label", F.greatest("up", F.coalesce("top", "up")).alias("new")))
        labels = new.select(*keys, "node", F.col("new").alias("label"))
        if last is not None:
            discard(last)
        last = new
        if new.filter("new <> label").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")
