"""Threshold studies: noise, decoding, verification and statistics of all points as one plan."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import color, decode, dual, matching, observables, verify
from .plans import grids
from .sources import dem, noise, sinks
from .streaming import window


#: Rates that differ by less count as one.
SAME_RATE = 1e-9


def distinct_rates(rates: list[float]) -> list[float]:
    """The rates in ascending order, those within SAME_RATE of the one before left out."""
    found: list[float] = []
    for p in sorted(float(p) for p in rates):
        if not found or p - found[-1] > SAME_RATE:
            found.append(p)
    return found


def _noisy_shots(spark: SparkSession, rates: list[float], shots: int) -> DataFrame:
    """(shot_id, shot, p) of every rate's shots; a shot's key is rate * shots + shot."""
    at = spark.createDataFrame([(k, p) for k, p in enumerate(distinct_rates(rates))], "rate int, p double")
    rows = spark.range(shots).select(F.col("id").alias("shot")).crossJoin(F.broadcast(at))  # a few rates
    return rows.select((F.col("rate") * F.lit(shots).cast("bigint") + F.col("shot")).alias("shot_id"), "shot", "p")


def threshold_study(spark: SparkSession, distances: list[int], rates: list[float], shots: int, seed: int = 42, two_bases: bool = False, depth: int | None = None) -> DataFrame:
    """Points (distance, p, rounds, shots, errors, verified, ler, ci_low, ci_high, ..) of the phenomenological model.

    All rates of a distance are sampled and decoded together; decode_us is the kernel's mean time by shot.
    """
    out = None
    for d in distances:
        grid = grids.rotated_surface(d, depth)
        all_ = _noisy_shots(spark, rates, shots)
        where = noise.error_locations(spark, grid, time_edges=grid.depth > 1).select("edge", "u", "v", "frame")
        errors = noise.with_hits(all_.crossJoin(F.broadcast(where)), F.col("p"), seed).select("shot_id", "edge", "u", "v", "frame")  # a few thousand error locations
        defects = noise.defects_of(errors)
        if two_bases:
            found = dual.decode(defects, grid)
            predicted = dual.predicted(found)
            open_ = found.groupBy("shot_id").agg(F.sum("n_unresolved").alias("open"), F.first("decode_us").alias("decode_us"))
        else:
            found = decode.decode(defects, grid, carry=True)
            predicted = observables.predicted(decode.corrections(found), grid)
            open_ = found.select("shot_id", F.col("n_unresolved").alias("open"), "decode_us")
        truth = all_.select("p", "shot_id").join(noise.flips_of(errors), "shot_id", "left").join(predicted, "shot_id", "left").join(open_, "shot_id", "left")
        flips, guess = F.coalesce("logical_flips", F.lit(0)), F.coalesce("predicted", F.lit(0))
        wrong = flips.bitwiseXOR(guess)
        points = truth.groupBy("p").agg(
            F.count("*").alias("shots"),
            F.count_if(wrong != 0).alias("errors"),
            F.count_if(wrong.bitwiseAND(1) != 0).alias("x_errors"),
            F.count_if(wrong.bitwiseAND(2) != 0).alias("z_errors"),
            F.count_if(flips != 0).alias("no_decoder_errors"),
            F.count_if(F.coalesce("open", F.lit(0)) == 0).alias("verified"),
            F.coalesce(F.avg("decode_us"), F.lit(0.0)).alias("decode_us"),
        )
        points = points.select(F.lit(d).cast("bigint").alias("distance"), F.lit(grid.depth).cast("bigint").alias("rounds"), "*")
        out = points if out is None else out.unionByName(points)
    return stats.threshold_points(out)


def model_study(spark: SparkSession, folder: str, shots: int, seed: int = 42) -> DataFrame:
    """A point (distance, p, rounds, shots, errors, ler, ..) for each *.dem file of a folder, with its mechanisms by class.

    Shots are sampled from all mechanisms and decoded on the graph of those with one or two detectors; an error is a
    shot whose predicted observables differ from the sampled ones. A file is a model, so files are few.
    """
    rows = dem.lines(spark, folder)
    about = dem.names(rows.select("dem_id").distinct(), "dem_id").join(dem.classes(dem.mechanisms(rows)), "dem_id").join(dem.counts(rows), "dem_id")
    out = None
    for model in sorted(about.collect(), key=lambda r: (r.distance or 0, r.p or 0.0, r.dem_id)):
        mech = dem.mechanisms(rows.filter(F.col("dem_id") == model.dem_id))
        edges = decode.model_edges(mech)
        fired = dem.sample(spark, mech, shots, seed)
        found = decode.decode_graph(dem.sampled_defects(fired).withColumnRenamed("det_id", "node"), edges, carry=True)
        truth = noise.shots(spark, shots).join(noise.flips_of(fired), "shot_id", "left").select("shot_id", F.coalesce("logical_flips", F.lit(0)).alias("logical_flips"))
        time = found.agg(F.coalesce(F.avg("decode_us"), F.lit(0.0)).alias("decode_us"), F.coalesce(F.sum("n_unresolved"), F.lit(0)).alias("unresolved"))
        point = verify.compare(truth, decode.frames(found, edges)).crossJoin(time)  # one row each
        point = point.select(*[F.lit(model[f.name]).cast(f.dataType).alias(f.name) for f in about.schema.fields], "*")
        out = point if out is None else out.unionByName(point)
    if out is None:
        raise ValueError(f"no *.dem file in {folder}")
    return stats.threshold_points(out.withColumn("rounds", F.coalesce("rounds", F.lit(1).cast("bigint"))))


def color_study(spark: SparkSession, distances: list[int], rates: list[float], shots: int, seed: int = 42) -> DataFrame:
    """Points (distance, p, rounds, shots, errors, red, green, blue, flipped, resolved, ler, ..) of colour codes.

    Single detectors flip by themselves; red, green and blue are their defects by colour, flipped the shots whose own
    observable frame is not zero, and an error a shot whose frame differs from the one its corrections predict.
    """
    out = None
    for d in distances:
        grid = grids.color_code(d)
        for p in distinct_rates(rates):
            hits = noise.color(spark, grid, p, shots, seed)
            found = color.decode(hits.select("shot_id", "node"), grid)
            guess = color.frames(found, grid).groupBy("shot_id").agg(F.bit_xor("flips").alias("predicted"))
            truth = hits.groupBy("shot_id").agg(F.bit_xor("flip").alias("flips"), *[F.count_if(F.col("color") == k).alias(name) for k, name in enumerate(color.NAMES)])
            open_ = found.groupBy("shot_id").agg(F.sum("n_unresolved").alias("open"), F.first("decode_us").alias("decode_us"))
            shot = noise.shots(spark, shots).join(truth, "shot_id", "left").join(guess, "shot_id", "left").join(open_, "shot_id", "left")
            flips = F.coalesce("flips", F.lit(0))
            point = shot.agg(F.count("*").alias("shots"), F.count_if(flips != F.coalesce("predicted", F.lit(0))).alias("errors"), F.count_if(flips != 0).alias("flipped"), F.count_if(F.coalesce("open", F.lit(0)) == 0).alias("resolved"), F.coalesce(F.avg("decode_us"), F.lit(0.0)).alias("decode_us"), *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in color.NAMES])
            point = point.select(F.lit(d).cast("bigint").alias("distance"), F.lit(p).alias("p"), F.lit(grid.depth).cast("bigint").alias("rounds"), "*")
            out = point if out is None else out.unionByName(point)
    return stats.threshold_points(out)


def stream_study(spark: SparkSession, d: int, rates: float | list[float], streams: int, size: int = 3, seed: int = 42, timed: bool = False) -> DataFrame:
    """Points (distance, p, window, streams, rounds, defects, commits, remaining, errors, ..) of a sliding-window decoder.

    errors: streams whose committed observables differ from the sampled ones. timed: ingest_us, commit_us, flush_us,
    decode_us and memory as well, each stream decoded by itself; they are null otherwise.
    """
    grid, out, size = grids.rotated_surface(d), None, min(size, d)
    n, layer = grid.stride_y, grids.next_power_of_two(max(grid.width, grid.height))
    for p in distinct_rates(rates if isinstance(rates, list) else [rates]):
        errors = noise.correlated(spark, grid, p, 0.0, streams, seed, time_edges=False)
        defects = noise.defects_of(errors)
        cells = defects.select(F.col("shot_id").alias("stream_id"), F.floor(F.col("node") / (n * n)).alias("round"), (F.col("node") % n).alias("x"), (F.floor(F.col("node") / n) % n).alias("y"), F.lit(True).alias("on"))
        commits = window.replay(cells, grid.width, grid.height, size)
        left = verify.remaining(cells.select(F.col("stream_id").alias("shot_id"), (F.col("round") * layer * layer + F.col("y") * layer + F.col("x")).alias("node")), commits.select(F.col("stream_id").alias("shot_id"), "u", "v"))
        guess = commits.groupBy(F.col("stream_id").alias("shot_id")).agg(F.bit_xor("observable").alias("predicted"))
        truth = noise.shots(spark, streams).join(noise.flips_of(errors), "shot_id", "left").select("shot_id", F.coalesce("logical_flips", F.lit(0)).alias("logical_flips"))
        took = window.latencies(cells, grid.width, grid.height, size) if timed else spark.createDataFrame([], window.LATENCY)
        means = took.agg(F.avg("ingest_us").alias("ingest_us"), F.avg("commit_us").alias("commit_us"), (F.avg("flush_us") / grid.depth).alias("flush_us"), F.avg(F.col("ingest_us") * F.least("rounds", F.lit(size)) + F.col("commit_us") * F.greatest(F.col("rounds") - size, F.lit(0)) + F.col("flush_us")).alias("decode_us"))
        point = verify.compare(truth, guess).crossJoin(defects.agg(F.count("*").alias("defects"))).crossJoin(commits.agg(F.count("*").alias("commits"))).crossJoin(left.agg(F.count("*").alias("remaining"))).crossJoin(means)  # one row each
        point = point.select(F.lit(d).cast("bigint").alias("distance"), F.lit(p).alias("p"), F.lit(size).cast("bigint").alias("window"), F.lit(grid.depth).cast("bigint").alias("rounds"), "*", F.lit(grids.streaming_buffer_size(grid.width, grid.height, size)).cast("bigint").alias("memory"))
        out = point if out is None else out.unionByName(point)
    return stats.threshold_points(out)


def compare_study(spark: SparkSession, distances: list[int], rates: list[float], shots: int, seed: int = 42) -> DataFrame:
    """(distance, p, shots, clusters_errors, matching_errors, heavier): cluster growth against exact matching of the shots with 1 to matching.MOST defects.

    heavier: shots whose correction has fewer edges than the least weight, which must be none.
    """
    out = None
    for d in distances:
        grid = grids.rotated_surface(d, 1)
        for p in distinct_rates(rates):
            errors = noise.correlated(spark, grid, p, 0.0, shots, seed, time_edges=False)
            defects = noise.defects_of(errors)
            exact = matching.decode(defects, grid)
            found = decode.decode(defects, grid, most=matching.MOST)
            ours = found.select("shot_id", F.size("u").alias("edges")).join(observables.predicted(decode.corrections(found), grid).withColumnRenamed("predicted", "guess"), "shot_id", "left")
            rows = exact.join(ours, "shot_id").join(noise.flips_of(errors), "shot_id", "left")
            flips = F.coalesce("logical_flips", F.lit(0))
            point = rows.agg(F.count("*").alias("shots"), F.count_if(flips != F.coalesce("guess", F.lit(0))).alias("clusters_errors"), F.count_if(flips != F.col("predicted")).alias("matching_errors"), F.count_if(F.col("edges") < F.col("weight")).alias("heavier"))
            point = point.select(F.lit(d).cast("bigint").alias("distance"), F.lit(p).alias("p"), "*")
            out = point if out is None else out.unionByName(point)
    return out


def _numbers(kind):
    return lambda text: [kind(x) for x in text.split(",")]


def arguments() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="syndromeframe", description="Studies of syndrome decoding on Spark.")
    a.add_argument("--distances", type=_numbers(int), default=[3, 5, 7])
    a.add_argument("--error-probs", type=_numbers(float), default=None)
    a.add_argument("--shots", type=int, default=10_000)
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--dem-dir", help="sample and decode the error models of a folder")
    a.add_argument("--dual-decode", action="store_true", help="decode X and Z apart")
    a.add_argument("--mode-2d", action="store_true", help="one round")
    a.add_argument("--color", action="store_true", help="colour codes")
    a.add_argument("--compare", action="store_true", help="cluster growth against exact matching")
    a.add_argument("--streaming", action="store_true", help="sliding window over rounds, with latencies")
    a.add_argument("--window", type=int, default=3)
    a.add_argument("--threshold-study", action="store_true", help="print suppression factors, too")
    a.add_argument("--helios", action="store_true", help="distance 13 at 0.1 %%, 50,000 shots")
    a.add_argument("--quick-bench", type=int, metavar="DISTANCE")
    a.add_argument("--csv", action="store_true")
    a.add_argument("--out", help="folder for CSV files")
    return a


def main(argv: list[str] | None = None) -> None:
    o = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("syndromeframe").getOrCreate()
    if o.helios:
        o.distances, o.error_probs, o.shots = [13], [0.001], 50_000
    if o.quick_bench:
        o.distances, o.error_probs = [o.quick_bench], [0.001]
    rates = o.error_probs or list(grids.ERROR_RATES)
    if o.compare:
        compare_study(spark, o.distances, rates, o.shots, o.seed).show(1000, False)
        return
    if o.dem_dir:
        points, header, lines = model_study(spark, o.dem_dir, o.shots, o.seed), sinks.THRESHOLD_HEADER, sinks.threshold_lines
    elif o.streaming:
        points, header, lines = None, sinks.STREAMING_HEADER, sinks.streaming_lines
        for d in o.distances:
            found = stream_study(spark, d, rates, o.shots, o.window, o.seed, timed=True)
            points = found if points is None else points.unionByName(found)
    elif o.color:
        points, header, lines = color_study(spark, o.distances, rates, o.shots, o.seed), sinks.COLOR_HEADER, sinks.color_lines
    else:
        points = threshold_study(spark, o.distances, rates, o.shots, o.seed, o.dual_decode, 1 if o.mode_2d else None)
        header, lines = sinks.THRESHOLD_HEADER, sinks.threshold_lines
        if o.dual_decode:
            points = points.withColumns({"x_us": F.col("decode_us") / 2, "z_us": F.col("decode_us") / 2}).drop("x_ler", "z_ler", "combined_ler")
            points = stats.dual_points(points.withColumn("combined_errors", F.col("errors")))
            header, lines = sinks.DUAL_HEADER, sinks.dual_lines
    points = points.cache()
    if o.out:
        sinks.write_lines(lines(points), header, o.out)
    elif o.csv:
        print(header, *[r.line for r in lines(points).collect()], sep="\n")
    else:
        points.orderBy("distance", "p").show(1000, False)
    if o.threshold_study:
        stats.suppression(points).orderBy("p", "d_low").show(1000, False)
    points.unpersist()
