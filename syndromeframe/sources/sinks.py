"""CSV lines of studies, as the published result files have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the result files.
THRESHOLD_HEADER = "distance,physical_p,rounds,shots,logical_errors,ler_per_round,ler_ci_low,ler_ci_high,decode_us,time_per_round_us"
DUAL_HEADER = "distance,physical_p,rounds,shots,x_errors,z_errors,combined_errors,x_ler,z_ler,combined_ler,x_decode_us,z_decode_us,total_decode_us"

STREAMING_HEADER = "distance,physical_p,window_size,rounds,shots,logical_errors,ler_per_round,ler_ci_low,ler_ci_high,ingest_avg_us,commit_avg_us,flush_per_round_us,total_decode_us,time_per_round_us,memory_bytes"
COLOR_HEADER = "distance,error_rate,shots,rounds,logical_errors,ler_per_round,decode_time_us,defects_red,defects_green,defects_blue"


def threshold_lines(points: DataFrame) -> DataFrame:
    """(line) of points (distance, p, rounds, shots, errors, ler, ci_low, ci_high, decode_us, round_us)."""
    cols = ["distance", "p", "rounds", "shots", "errors", "ler", "ci_low", "ci_high", "decode_us", "round_us"]
    return points.select(F.format_string("%d,%.6f,%d,%d,%d,%.6e,%.6e,%.6e,%.3f,%.4f", *cols).alias("line"))


def dual_lines(points: DataFrame) -> DataFrame:
    """(line) of points with errors and rates of both bases, and x_us and z_us."""
    cols = ["distance", "p", "rounds", "shots", "x_errors", "z_errors", "combined_errors", "x_ler", "z_ler", "combined_ler", "x_us", "z_us"]
    return points.select(F.format_string("%d,%.6f,%d,%d,%d,%d,%d,%.6e,%.6e,%.6e,%.3f,%.3f,%.3f", *cols, F.col("x_us") + F.col("z_us")).alias("line"))


def streaming_lines(points: DataFrame) -> DataFrame:
    """(line) of points with window, ingest_us, commit_us, flush_us, decode_us, round_us and memory."""
    cols = ["distance", "p", "window", "rounds", "shots", "errors", "ler", "ci_low", "ci_high", "ingest_us", "commit_us", "flush_us", "decode_us", "round_us", "memory"]
    return points.select(F.format_string("%d,%.6f,%d,%d,%d,%d" + ",%.6e" * 3 + ",%.3f" * 5 + ",%d", *cols).alias("line"))


def color_lines(points: DataFrame) -> DataFrame:
    """(line) of points with the numbers of red, green and blue defects."""
    cols = ["distance", "p", "shots", "rounds", "errors", "ler", "decode_us", "red", "green", "blue"]
    return points.select(F.format_string("%d,%.6f,%d,%d,%d,%.6e,%.2f,%d,%d,%d", *cols).alias("line"))


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """A folder of CSV files, each beginning with the header."""
    parts = F.split("line", ",")
    lines.select(*[F.get(parts, F.lit(k)).alias(name) for k, name in enumerate(header.split(","))]).write.mode("overwrite").option("header", True).csv(path)
