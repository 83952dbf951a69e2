"""Logical observables that a correction flips."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.grids import Grid


class Mode(Enum):
    DISABLED = "disabled"
    PHENOMENOLOGICAL = "phenomenological"
    CIRCUIT_LEVEL = "circuit_level"


def lookup(corrections: DataFrame, edge_lut: DataFrame, boundary_lut: DataFrame) -> DataFrame:
    """corrections with their observable: by (u, v) or, at the boundary, by u; 0 where the tables have no row.

    Both tables are relations of the lattice.
    """
    c = corrections.join(edge_lut.select("u", "v", F.col("observable").alias("inner_bit")), ["u", "v"], "left")
    c = c.join(boundary_lut.select(F.col("node").alias("u"), F.col("observable").alias("outer_bit")), "u", "left")
    return c.select("shot_id", "u", "v", F.coalesce(F.when(F.col("v").isNull(), F.col("outer_bit")).otherwise(F.col("inner_bit")), F.lit(0)).cast("bigint").alias("observable"))


def predicted(corrections: DataFrame, grid: Grid, mode: Mode = Mode.PHENOMENOLOGICAL, luts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(shot_id, predicted) of every shot with a correction: the XOR of its edges' observables."""
    if mode is Mode.CIRCUIT_LEVEL:
        rows = lookup(corrections, *luts)
    else:
        x, y, _ = ids.coord(grid, "u")
        bit = F.when(F.col("v").isNull(), ids.boundary_observable(grid, x, y)).otherwise(0) if mode is Mode.PHENOMENOLOGICAL else F.lit(0)
        rows = corrections.select("shot_id", bit.cast("bigint").alias("observable"))
    return rows.groupBy("shot_id").agg(F.bit_xor("observable").alias("predicted"))
