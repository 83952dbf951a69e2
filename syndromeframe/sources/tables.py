"""Defect relations derived from tables of orders, line items, events, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.grids import Grid

CUBE = Grid(8, 8, 7, "grid3d")
SQUARE = Grid(17, 17)
FACES = Grid(9, 9)
LAYER = (4, 4)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shot_id, node): one toggle for each line item on the 8 x 8 x 7 lattice."""
    x, y, t = F.col("l_partkey") % 8, F.col("l_suppkey") % 8, F.col("l_linenumber") - 1
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("shot_id"), ids.node(CUBE, x, y, t).alias("node"))


def square_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_partkey") % 17, (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 17
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("shot_id"), ids.node(SQUARE, x, y).alias("node"))


def face_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("o_orderkey") % 9, F.floor(F.col("o_orderkey") / 9) % 9
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("bigint").alias("shot_id"), ids.node(FACES, x, y).alias("node"))


def parity(toggles: DataFrame) -> DataFrame:
    """(shot_id, node) of the nodes toggled an odd number of times, dealt by shot for what follows."""
    return toggles.repartition("shot_id").groupBy("shot_id", "node").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("shot_id", "node")


def with_coord(defects: DataFrame, grid: Grid) -> DataFrame:
    x, y, t = ids.coord(grid, "node")
    return defects.select("*", x.alias("x"), y.alias("y"), t.alias("t"))


def event_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, round, x, y, on): a user's events in order, a defect for errors and clicks."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("bigint").alias("stream_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("round"),
        (F.col("event_id") % 4).cast("bigint").alias("x"),
        (F.floor(F.col("event_id") / 4) % 4).cast("bigint").alias("y"),
        F.col("event_type").isin("error", "click").alias("on"),
    )


def study_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, distance, p, errors, shots) for statistics."""
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("bigint").alias("part"),
        (3 + 2 * (F.col("p_size") % 4)).cast("bigint").alias("distance"),
        (1 + F.col("p_partkey") % 5).cast("bigint").alias("p_milli"),
        (F.col("p_partkey") % 97).cast("bigint").alias("errors"),
        F.lit(1000).cast("bigint").alias("shots"),
    )
