"""Detector error models in Stim's text format, read and sampled with DataFrame functions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import noise


#: The line that stands for the missing end of a repeat block.
UNCLOSED = "repeat {"


def expand(text: str) -> str:
    """The text with repeat blocks written out; the body's shifts add up as in a run."""
    out: list[list[str]] = [[]]
    times: list[int] = []
    for line in text.splitlines():
        word = line.strip()
        if m := re.match(r"repeat\s+(\d+)\s*\{", word):
            times.append(int(m[1]))
            out.append([])
        elif word.startswith("}") and times:
            body = out.pop()
            out[-1] += body * times.pop()
        else:
            out[-1].append(line)
    while times:  # a block without its end counts once, and says so in a line that errors() finds
        body = out.pop()
        out[-1] += [*body, UNCLOSED]
        times.pop()
    return "\n".join(out[0])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(dem_id, line, text) of the *.dem files of a folder; a file is one model and must fit a row."""
    raw = spark.read.option("pathGlobFilter", "*.dem").text(path, wholetext=True).select(F.input_file_name().alias("dem_id"), "value")

    @F.arrow_udf("string")
    def blocks(texts: pa.Array) -> pa.Array:  # nested blocks need a parser
        return pa.array([expand(x) for x in texts.to_pylist()], pa.string())

    return raw.select("dem_id", F.posexplode(F.split(blocks("value"), r"\r?\n")).alias("line", "text"))


def of_text(spark: SparkSession, text: str, dem_id: str = "inline") -> DataFrame:
    """(dem_id, line, text) of a model given as a string."""
    rows = [(dem_id, k, line) for k, line in enumerate(expand(text).splitlines())]
    return spark.createDataFrame(rows, "dem_id string, line int, text string")


def names(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with distance, rounds and p from names such as .._d5_r5_p0.01.dem; nulls where a name has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return paths.select(
        "*",
        F.expr(f"try_cast(nullif(regexp_extract({path}, '_d([0-9]+)_', 1), '') AS bigint)").alias("distance"),
        F.expr(f"try_cast(nullif(regexp_extract({path}, '_r([0-9]+)_', 1), '') AS bigint)").alias("rounds"),
        F.when(name.endswith(".dem"), F.expr(f"try_cast(nullif(regexp_extract({path}, '_p([0-9.]+([eE][-+]?[0-9]+)?)[.]dem$', 1), '') AS double)")).alias("p"),
    )


def _kind() -> F.Column:
    return F.regexp_extract(F.trim("text"), r"^([a-z_]+)", 1)


def _shifted(rows: DataFrame) -> DataFrame:
    """rows with the detector and coordinate offsets that earlier shift_detectors lines add up to."""
    shift = _kind() == "shift_detectors"
    order = Window.partitionBy("dem_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    body = F.regexp_extract("text", r"\(([^)]*)\)", 1)

    def coordinate(k: int):
        return F.coalesce(F.expr(f"try_cast(trim(try_element_at(split(_body, ','), {k})) AS double)"), F.lit(0.0))

    rows = rows.withColumn("_body", F.when(shift, body).otherwise(""))
    by = F.expr(r"try_cast(nullif(regexp_extract(text, '([0-9]+)\\s*$', 1), '') AS bigint)")
    rows = rows.withColumn("_by", F.when(shift, F.coalesce(by, F.lit(0))).otherwise(0))
    out = rows.select("dem_id", "line", "text", F.coalesce(F.sum("_by").over(order), F.lit(0)).alias("id_shift"), *[F.coalesce(F.sum(coordinate(k + 1)).over(order), F.lit(0.0)).alias(f"d{axis}") for k, axis in enumerate("xyt")])
    return out


def detectors(rows: DataFrame) -> DataFrame:
    """(dem_id, det_id, x, y, t); missing or bad coordinates are 0."""
    found = _shifted(rows).filter(_kind() == "detector")
    body = found.withColumn("_body", F.regexp_extract("text", r"\(([^)]*)\)", 1))
    ident = F.expr("try_cast(nullif(regexp_extract(text, 'D([0-9]+)', 1), '') AS bigint)")

    def axis(k: int, name: str):
        return (F.coalesce(F.expr(f"try_cast(trim(try_element_at(split(_body, ','), {k})) AS double)"), F.lit(0.0)) + F.col(f"d{name}")).alias(name)

    return body.select("dem_id", (ident + F.col("id_shift")).alias("det_id"), axis(1, "x"), axis(2, "y"), axis(3, "t")).filter("det_id IS NOT NULL")


def mechanisms(rows: DataFrame, compat: bool = False) -> DataFrame:
    """(dem_id, mech_id, p, detectors, frame) of the error lines, in order.

    Detectors are those of all components, one that occurs twice cancels; frame is the mask of observables 0 to
    7, wherever they stand. compat: detectors only before the first ^ and observables only in the part behind it.
    """
    found = _shifted(rows).filter(_kind() == "error")
    p = F.expr(r"try_cast(regexp_extract(text, '\\(([^)]*)\\)', 1) AS double)")
    parts = F.split("text", r"\^")
    d_text = F.get(parts, F.lit(0)) if compat else F.col("text")
    l_text = F.coalesce(F.get(parts, F.lit(1)), F.lit("")) if compat else F.col("text")
    d = F.transform(F.regexp_extract_all(d_text, F.lit(r"(?:^|\s)D([0-9]+)"), F.lit(1)), lambda s: s.cast("bigint"))
    obs = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(l_text, F.lit(r"(?:^|\s)L([0-9]+)"), F.lit(1)), lambda s: s.cast("int")), lambda k: k < 8))
    found = found.select("dem_id", "line", p.alias("p"), F.transform(d, lambda k: k + F.col("id_shift")).alias("d"), obs.alias("obs")).filter("p IS NOT NULL")
    odd = F.array_sort(F.filter(F.array_distinct("d"), lambda k: F.size(F.filter("d", lambda j: j == k)) % 2 == 1))
    frame = F.aggregate("obs", F.lit(0).cast("bigint"), lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    order = Window.partitionBy("dem_id").orderBy("line")
    return found.select("dem_id", (F.row_number().over(order) - 1).cast("bigint").alias("mech_id"), "p", odd.alias("detectors"), frame.alias("frame"))


def errors(rows: DataFrame) -> DataFrame:
    """(dem_id, line, text, kind) of lines that can't be read: syntax, probability, detector, observable or unexpected_end.

    A line that opens a bracket and a repeat block that isn't closed end unexpectedly.
    """
    k, t = _kind(), F.trim("text")
    bad_p = F.expr(r"try_cast(regexp_extract(text, '\\(([^)]*)\\)', 1) AS double)").isNull()
    kind = (
        F.when((t == "") | t.startswith("#") | t.startswith("}"), None)
        .when((t == UNCLOSED) | (t.contains("(") & ~t.contains(")")), "unexpected_end")
        .when(k == "", "syntax")
        .when((k == "error") & ~t.rlike(r"^error\s*\("), "syntax")
        .when((k == "error") & bad_p, "probability")
        .when((k == "detector") & ~t.rlike(r"D[0-9]+"), "detector")
        .when(t.rlike(r"(?:^|\s)D(?![0-9])"), "detector")
        .when(t.rlike(r"(?:^|\s)L(?![0-9])"), "observable")
    )
    return rows.select("dem_id", "line", "text", kind.alias("kind")).filter("kind IS NOT NULL")


def counts(rows: DataFrame) -> DataFrame:
    """(dem_id, detectors, observables): largest id and one more."""
    d = detectors(rows).select("dem_id", "det_id").unionByName(mechanisms(rows).select("dem_id", F.explode("detectors").alias("det_id")))
    obs = rows.select("dem_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|\s)L([0-9]+)"), F.lit(1))).alias("k")).groupBy("dem_id").agg((F.max(F.col("k").cast("bigint")) + 1).alias("observables"))
    return d.groupBy("dem_id").agg((F.max("det_id") + 1).alias("detectors")).join(obs, "dem_id", "left").select("dem_id", "detectors", F.coalesce("observables", F.lit(0)).alias("observables"))


def classes(mech: DataFrame) -> DataFrame:
    """(dem_id, boundary, edge, hyperedge, framed): mechanisms by their number of detectors, and those with a frame."""
    n = F.size("detectors")
    return mech.groupBy("dem_id").agg(F.count_if(n == 1).alias("boundary"), F.count_if(n == 2).alias("edge"), F.count_if(n > 2).alias("hyperedge"), F.count_if(F.col("frame") != 0).alias("framed"))


def sample(spark: SparkSession, mech: DataFrame, n_shots: int, seed: int = 42) -> DataFrame:
    """(shot_id, mech_id, detectors, frame): mechanisms that fire, independently by their probability."""
    return noise.sample(spark, mech.select(F.col("mech_id").alias("edge"), "p", "detectors", "frame"), n_shots, seed).withColumnRenamed("edge", "mech_id")


def sampled_defects(fired: DataFrame) -> DataFrame:
    """(shot_id, det_id) of detectors that an odd number of mechanisms flips."""
    rows = fired.select("shot_id", F.explode("detectors").alias("det_id"))
    return rows.groupBy("shot_id", "det_id").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("shot_id", "det_id")


def remap(defects: DataFrame, found: DataFrame, grid) -> DataFrame:
    """(shot_id, node) by rounded detector coordinates: colliding detectors merge, unknown ones and those outside drop."""
    from ..functions import ids

    x, y, t = ids.int_coord("x"), ids.int_coord("y"), ids.int_coord("t")
    at = found.filter(ids.in_bounds(grid, x, y, t)).select("det_id", ids.node(grid, x, y, t).alias("node"))
    return defects.join(F.broadcast(at), "det_id").select("shot_id", "node").distinct()
