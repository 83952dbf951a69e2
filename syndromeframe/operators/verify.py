"""Syndrome annihilation: a correction is right if toggling its endpoints clears every defect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.grids import Grid


def remaining(defects: DataFrame, corrections: DataFrame, grid: Grid | None = None) -> DataFrame:
    """(shot_id, node) still set after the correction; with a grid only valid nodes count. One shuffle."""
    ends = corrections.select("shot_id", F.explode(F.array("u", "v")).alias("node")).filter("node IS NOT NULL")
    rows = defects.select("shot_id", "node").unionByName(ends)
    if grid is not None:
        x, y, t = ids.coord(grid, "node")
        rows = rows.filter((F.col("node") >= 0) & ids.in_bounds(grid, x, y, t))
    return rows.groupBy("shot_id", "node").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("shot_id", "node")


def resolved(defects: DataFrame, corrections: DataFrame, grid: Grid | None = None) -> DataFrame:
    """(shot_id, n_defects, remaining, resolved) of every shot that has a defect row.

    Defects and endpoints go through one shuffle, by shot, which both aggregations then share.
    """
    ends = corrections.select("shot_id", F.explode(F.array("u", "v")).alias("node"), F.lit(0).alias("own")).filter("node IS NOT NULL")
    rows = defects.select("shot_id", "node", F.lit(1).alias("own")).unionByName(ends).repartition("shot_id")
    by_node = rows.groupBy("shot_id", "node").agg(F.sum("own").alias("own"), F.count("*").alias("n"))
    left = F.col("n") % 2 == 1
    if grid is not None:
        x, y, t = ids.coord(grid, "node")
        left = left & (F.col("node") >= 0) & ids.in_bounds(grid, x, y, t)
    shots = by_node.groupBy("shot_id").agg(F.count_if(F.col("own") % 2 == 1).alias("n_defects"), F.count_if(left).alias("remaining"), F.sum("own").alias("own"))
    return shots.filter("own > 0").select("shot_id", "n_defects", "remaining", (F.col("remaining") == 0).alias("resolved"))


def carried(decoded: DataFrame) -> DataFrame:
    """(.., n_defects, remaining, resolved) of rows that decoding with carry=True has left with their defects: no shuffle."""
    found = packed_remaining(decoded)
    return found.withColumn("resolved", F.col("remaining") == 0)


def packed_remaining(decoded: DataFrame, defects: str = "defects") -> DataFrame:
    """decoded rows that carry their defects as an array: number of nodes still set, without a shuffle."""
    ends = F.concat(F.col(defects), F.col("u"), F.filter("v", lambda x: x.isNotNull()))
    ordered = F.array_sort(ends)
    # runs of equal nodes: toggle on a change of node
    state = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("odd"))
    done = F.aggregate(ordered, state, lambda s, x: F.struct(x.alias("last"), F.when(s["last"] == x, 1 - s["n"]).otherwise(1).alias("n"), (s["odd"] + F.when(s["last"] == x, F.when(s["n"] == 1, -1).otherwise(1)).otherwise(1)).alias("odd")))
    return decoded.withColumn("remaining", done["odd"])


def edge_parity(choice: DataFrame, endpoints: DataFrame, defects: DataFrame) -> DataFrame:
    """(shot_id, node) where the incidence matrix times the chosen edges differs from the syndrome.

    choice: (shot_id, edge_id); endpoints: (edge_id, u, v). The lattice's edges are a fixed, small relation.
    """
    ends = choice.join(endpoints, "edge_id").select("shot_id", "u", "v")
    return remaining(defects, ends)


def compare(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(shots, errors): shots whose predicted logical flips differ from the truth; no prediction counts as 0."""
    both = truth.join(predicted, "shot_id", "left").select(F.col("logical_flips"), F.coalesce("predicted", F.lit(0)).alias("predicted"))
    return both.agg(F.count("*").alias("shots"), F.count_if(F.col("logical_flips") != F.col("predicted")).alias("errors"))
