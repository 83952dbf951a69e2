"""Colour codes: faces by (x + y) mod 3, their compact lattices, restriction and single-colour decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.grids import Grid, restricted
from . import decode as decoding
from . import lattice

NAMES = ("red", "green", "blue")


def restriction(spark: SparkSession, grid: Grid) -> DataFrame:
    """(color, idx, node, x, y, t): dense number of each face within its colour, in (t, y, x) order."""
    n = lattice.nodes(spark, grid).withColumn("color", ids.color("x", "y"))
    return n.select("color", (F.row_number().over(Window.partitionBy("color").orderBy("t", "y", "x")) - 1).cast("bigint").alias("idx"), "node", "x", "y", "t")


def restrict(defects: DataFrame, maps: DataFrame) -> DataFrame:
    """(shot_id, color, idx) of the defects; maps is a relation of the lattice and small."""
    return defects.select("shot_id", "node").join(F.broadcast(maps.select("node", "color", "idx")), "node").select("shot_id", "color", "idx")


def lift(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """(shot_id, node) of dense numbers by colour; a null number, the boundary, stays null."""
    return rows.join(F.broadcast(maps.select("color", "idx", "node")), ["color", "idx"], "left").select("shot_id", "node")


def counts(defects: DataFrame, grid: Grid) -> DataFrame:
    """(shot_id, red, green, blue) numbers of defects and whether all three are even."""
    x, y, _ = ids.coord(grid, "node")
    c = defects.select("shot_id", ids.color(x, y).alias("c")).groupBy("shot_id").agg(*[F.count_if(F.col("c") == k).alias(name) for k, name in enumerate(NAMES)])
    return c.withColumn("parity_ok", (F.col("red") % 2 == 0) & (F.col("green") % 2 == 0) & (F.col("blue") % 2 == 0))


def _phantoms(grid: Grid, color: int) -> frozenset[int]:
    """Compact nodes without a face: rows whose colour has fewer columns than the widest."""
    small = restricted(grid)
    return frozenset(small.node(k, y, t) for t in range(grid.depth) for y in range(grid.height) for k in range(small.width) if (color - y) % 3 + 3 * k >= grid.width)


def decode(toggles: DataFrame, grid: Grid) -> DataFrame:
    """(shot_id, color, n_defects, n_unresolved, u, v, defects, decode_us): each colour restricted to its lattice, all decoded as one graph.

    Faces of a colour are neighbours if they follow each other in a row (columns 3 apart), stand above each
    other by their place in the row, or in time; top and bottom rows carry the boundary. u, v and defects are
    nodes of the full lattice.
    """
    small = restricted(grid)
    x, y, t = ids.coord(grid, "node")
    rows = toggles.select("shot_id", ids.color(x, y).cast("int").alias("part"), ids.node(small, F.floor(x / 3), y, t).alias("node"))
    found = decoding.decode_parts(rows, [(small, _phantoms(grid, c)) for c in range(3)])

    def full(n):
        cx, cy, ct = ids.coord(small, n)
        return F.when(n.isNotNull(), ids.node(grid, F.pmod(F.col("part") - cy, F.lit(3)) + 3 * cx, cy, ct))

    return found.select("shot_id", F.col("part").alias("color"), "n_defects", "n_unresolved", *[F.transform(c, full).alias(c) for c in ("u", "v", "defects")], "decode_us")


def frames(decoded: DataFrame, grid: Grid) -> DataFrame:
    """(shot_id, color, flips): observables of the boundary edges on the first row, by colour."""
    edges = decoded.select("shot_id", "color", F.explode(F.arrays_zip("u", "v")).alias("e")).filter("e.v IS NULL")
    _, y, _ = ids.coord(grid, "e.u")
    bit = ids.color_observable("color", F.lit(True), F.when(y == 0, 0).otherwise(1))
    return edges.select("shot_id", "color", bit.alias("bit")).groupBy("shot_id", "color").agg(F.bit_xor("bit").alias("flips"))
