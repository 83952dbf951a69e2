"""X and Z stabilisers of one lattice, decoded apart on compact lattices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.grids import BOUNDARIES, Grid
from . import decode as decoding

BASES = ("X", "Z")


def compact(grid: Grid, basis: str) -> Grid:
    w, h = (-(-grid.width // 2), grid.height) if basis == "X" else (-(-grid.height // 2), grid.width)
    return Grid(w, h, grid.depth, grid.topology, BOUNDARIES["horizontal_only"])


def split(toggles: DataFrame, grid: Grid) -> DataFrame:
    """(shot_id, basis, cx, cy, t): even nodes are X, odd ones Z with x and y exchanged."""
    x, y, t = ids.coord(grid, "node")
    even = F.pmod(x + y, F.lit(2)) == 0
    (xx, xy), (zx, zy) = ids.x_compact(x, y), ids.z_compact(x, y)
    return toggles.select("shot_id", F.when(even, "X").otherwise("Z").alias("basis"), F.when(even, xx).otherwise(zx).alias("cx"), F.when(even, xy).otherwise(zy).alias("cy"), t.alias("t"))


def _phantoms(grid: Grid, basis: str) -> frozenset[int]:
    small, most = compact(grid, basis), grid.width if basis == "X" else grid.height
    first = (lambda row: row % 2) if basis == "X" else (lambda row: 1 - row % 2)
    return frozenset(small.node(k, row, t) for t in range(grid.depth) for row in range(small.height) for k in range(small.width) if first(row) + 2 * k >= most)


def decode(toggles: DataFrame, grid: Grid) -> DataFrame:
    """(shot_id, basis, n_defects, n_unresolved, u, v, defects, decode_us) on the compact lattices of both bases, decoded as one graph."""
    small = [compact(grid, basis) for basis in BASES]
    own = split(toggles, grid)
    z = F.col("basis") == "Z"
    rows = own.select("shot_id", z.cast("int").alias("part"), F.when(z, ids.node(small[1], "cx", "cy", "t")).otherwise(ids.node(small[0], "cx", "cy", "t")).alias("node"))
    found = decoding.decode_parts(rows, [(g, _phantoms(grid, basis)) for g, basis in zip(small, BASES, strict=True)])
    return found.select("shot_id", F.when(F.col("part") == 0, "X").otherwise("Z").alias("basis"), "n_defects", "n_unresolved", "u", "v", "defects", "decode_us")


def predicted(decoded: DataFrame) -> DataFrame:
    """(shot_id, predicted): bit 0 if the X basis has an odd number of edges to the first row's boundary, bit 1 for Z."""
    edges = decoded.select("shot_id", "basis", F.explode(F.arrays_zip("u", "v")).alias("e"))
    bit = F.when(F.col("basis") == "X", 1).otherwise(2).cast("bigint")
    return edges.filter("e.v IS NULL").select("shot_id", bit.alias("bit")).groupBy("shot_id").agg(F.bit_xor("bit").alias("predicted"))
