"""Noise generators: shots x error locations through an arithmetic random number, so that SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.grids import Grid

#: Cubing is a bijection modulo this prime.
P = 1_000_037


def _cubed(rows: DataFrame, name: str, x: Column) -> DataFrame:
    rows = rows.withColumn("_r", F.pmod(x, F.lit(P)))
    rows = rows.withColumn("_s", (F.col("_r") * F.col("_r")) % P)
    return rows.withColumn(name, (F.col("_s") * F.col("_r")) % P).drop("_r", "_s")


def with_hits(rows: DataFrame, p: Column | float, seed: int = 42, shot: str = "shot_id", edge: str = "edge") -> DataFrame:
    """The (shot, edge) rows that are hit with probability p."""
    s, e = ids.lng(shot), ids.lng(edge)
    rows = _cubed(rows, "_h", s * 48271 + 16807 * seed + 11)
    rows = _cubed(rows, "_h", F.col("_h") + e * 69621 + 7)
    rows = _cubed(rows, "_h", F.col("_h") + s * 40692 + e * 31 + 5)
    return rows.filter(F.col("_h") < F.floor(F.lit(p) * P if not isinstance(p, Column) else p * P)).drop("_h")


def shots(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("shot_id"))


def uniform(spark: SparkSession, grid: Grid, p: float, n_shots: int, seed: int = 42) -> DataFrame:
    """(shot_id, node): every detector by itself with probability p."""
    w, h = grid.width, grid.height
    rows = spark.range(n_shots * grid.num_detectors).select(F.floor(F.col("id") / grid.num_detectors).cast("bigint").alias("shot_id"), (F.col("id") % grid.num_detectors).alias("edge"))
    hit = with_hits(rows, p, seed)
    return hit.select("shot_id", ids.node(grid, F.col("edge") % w, F.floor(F.col("edge") / w) % h, F.floor(F.col("edge") / (w * h))).alias("node"))


def error_locations(spark: SparkSession, grid: Grid, time_edges: bool = True) -> DataFrame:
    """(edge, u, v, frame, spatial): where errors may occur; v is null for one-ended errors.

    In every round a left and a right end of each row (frame 2) and a first and a last end of each column
    (frame 1), and the row and column neighbours between (frame 0); between rounds each detector with itself,
    and alone in the first and in the last round (frame 0). Edges are numbered in this order.
    """
    w, h, d = grid.width, grid.height, grid.depth

    def part(nx: int, ny: int, nt: int, u, v, frame: int, spatial: bool) -> DataFrame:
        base = spark.range(max(0, nx * ny * nt)).select((F.col("id") % nx).alias("x"), (F.floor(F.col("id") / nx) % ny).alias("y"), F.floor(F.col("id") / (nx * ny)).alias("t"), F.col("id").alias("k")) if nx * ny * nt > 0 else spark.range(0).select(*[F.col("id").alias(c) for c in ("x", "y", "t", "k")])
        x, y, t = F.col("x"), F.col("y"), F.col("t")
        to = F.lit(None).cast("bigint") if v is None else ids.node(grid, *v(x, y, t))
        return base.select("k", ids.node(grid, *u(x, y, t)).alias("u"), to.alias("v"), F.lit(frame).cast("bigint").alias("frame"), F.lit(spatial).alias("spatial"))

    zero = F.lit(0)
    parts = [
        (part(1, h, d, lambda x, y, t: (zero, y, t), None, 2, True), h * d),
        (part(w - 1, h, d, lambda x, y, t: (x, y, t), lambda x, y, t: (x + 1, y, t), 0, True), (w - 1) * h * d),
        (part(1, h, d, lambda x, y, t: (F.lit(w - 1), y, t), None, 2, True), h * d),
        (part(w, 1, d, lambda x, y, t: (x, zero, t), None, 1, True), w * d),
        (part(w, h - 1, d, lambda x, y, t: (x, y, t), lambda x, y, t: (x, y + 1, t), 0, True), w * (h - 1) * d),
        (part(w, 1, d, lambda x, y, t: (x, F.lit(h - 1), t), None, 1, True), w * d),
    ]
    if time_edges:
        parts += [
            (part(w, h, d - 1, lambda x, y, t: (x, y, t), lambda x, y, t: (x, y, t + 1), 0, False), w * h * (d - 1)),
            (part(w, h, 1, lambda x, y, t: (x, y, zero), None, 0, False), w * h),
            (part(w, h, 1, lambda x, y, t: (x, y, F.lit(d - 1)), None, 0, False), w * h),
        ]
    out, start = None, 0
    for rows, size in parts:
        rows = rows.select((F.col("k") + start).alias("edge"), "u", "v", "frame", "spatial")
        out, start = rows if out is None else out.unionByName(rows), start + size
    return out


def sample(spark: SparkSession, locations: DataFrame, n_shots: int, seed: int = 42) -> DataFrame:
    """(shot_id, edge, u, v, frame) of every error that occurs; locations carry their probability p.

    Error locations are a fixed relation of the code or model, a few thousand rows; each shot meets all of them.
    """
    rows = shots(spark, n_shots).crossJoin(F.broadcast(locations))
    return with_hits(rows, F.col("p"), seed).drop("p")


def correlated(spark: SparkSession, grid: Grid, p_space: float, p_time: float, n_shots: int, seed: int = 42, time_edges: bool = True) -> DataFrame:
    """Errors (shot_id, edge, u, v, frame) of the phenomenological model."""
    where = error_locations(spark, grid, time_edges)
    where = where.select("edge", "u", "v", "frame", F.when(F.col("spatial"), p_space).otherwise(p_time).alias("p"))
    return sample(spark, where, n_shots, seed)


def defects_of(errors: DataFrame) -> DataFrame:
    """(shot_id, node) of the detectors that an odd number of errors touch."""
    ends = errors.select("shot_id", F.explode(F.array("u", "v")).alias("node")).filter("node IS NOT NULL")
    return ends.groupBy("shot_id", "node").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("shot_id", "node")


def flips_of(errors: DataFrame) -> DataFrame:
    """(shot_id, logical_flips) of shots with errors."""
    return errors.groupBy("shot_id").agg(F.bit_xor("frame").alias("logical_flips"))


def color(spark: SparkSession, grid: Grid, p: float, n_shots: int, seed: int = 42) -> DataFrame:
    """(shot_id, node, x, y, t, color, flip): single detectors, with the flip of red (1) and green (2) ones at x = 0."""
    hits = uniform(spark, grid, p, n_shots, seed)
    x, y, t = ids.coord(grid, "node")
    rows = hits.select("shot_id", "node", x.alias("x"), y.alias("y"), t.alias("t"), ids.color(x, y).alias("color"))
    return rows.withColumn("flip", ids.color_observable("color", F.col("x") == 0, F.lit(0)))
