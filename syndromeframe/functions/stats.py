"""Statistics of studies: rates, intervals, percentiles by nearest rank, suppression factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def wilson(successes: Column, trials: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval within [0, 1]; (0, 1) without trials."""
    n, k = trials.cast("double"), successes.cast("double")
    p, z2 = k / n, z * z
    denominator = 1 + z2 / n
    center = (p + z2 / (2 * n)) / denominator
    spread = z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / denominator
    none = trials == 0
    return F.when(none, 0.0).otherwise(F.greatest(center - spread, F.lit(0.0))), F.when(none, 1.0).otherwise(F.least(center + spread, F.lit(1.0)))


def rate(errors: Column, shots: Column, rounds: Column) -> Column:
    """Errors by shot and round; 0 without rounds."""
    total = (shots * rounds).cast("double")
    return F.when(total > 0, errors / total).otherwise(0.0)


def threshold_points(rows: DataFrame) -> DataFrame:
    """rows (distance, p, rounds, shots, errors, decode_us) with ler, ci_low, ci_high and round_us."""
    low, high = wilson(F.col("errors"), F.col("shots") * F.col("rounds"))
    return rows.select(
        "*",
        rate(F.col("errors"), F.col("shots"), F.col("rounds")).alias("ler"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        F.when(F.col("rounds") > 0, F.col("decode_us") / F.col("rounds")).otherwise(F.col("decode_us")).alias("round_us"),  # null where nothing was timed
    )


#: Ranges of values that a key's rows are ranked in.
RANGES = 1024


def _index(rank: str, q: float, n: Column) -> Column:
    """Position of percentile q among n sorted values by one of three rules, at most the last.

    round: q/100 (n - 1), half away from zero; trunc: n q/100; integer: n q div 100.
    """
    at = {"round": F.floor(F.lit(q / 100.0) * (n - 1) + 0.5), "trunc": F.floor(n * F.lit(q / 100.0)), "integer": F.floor(n * F.lit(int(q)) / 100)}[rank]
    return F.least(at, n - 1)


def percentiles(rows: DataFrame, key: list[str], value: str, qs=(50, 95, 99), ranks=("round",)) -> DataFrame:
    """(key.., n, mean, low, high, <rank>_p<q>..): nearest-rank percentiles of numbers, of all rules in one pass.

    Equal values are counted first; a key's values are then ranked in RANGES ranges of their own, so that no task holds
    a whole key. Null values are left out.
    """
    each = rows.filter(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    ends = each.groupBy(*key).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    dealt = each.join(ends, key).withColumn("range", F.least(F.floor(width * RANGES), F.lit(RANGES - 1)).cast("int"))
    sizes = dealt.groupBy(*key, "range").agg(F.sum("c").alias("size"))
    before = sizes.select(*key, "range", (F.sum("size").over(Window.partitionBy(*key).orderBy("range")) - F.col("size")).alias("before"))  # RANGES rows a key
    inside = F.sum("c").over(Window.partitionBy(*key, "range").orderBy("value")) - F.col("c")
    at = dealt.withColumn("inside", inside).join(before, [*key, "range"]).withColumn("first", F.col("before") + F.col("inside"))
    picks = []
    for rank in ranks:
        for q in qs:
            idx = _index(rank, q, F.col("n"))
            picks.append(F.max(F.when((F.col("first") <= idx) & (idx < F.col("first") + F.col("c")), F.col("value"))).alias(f"{rank}_p{q}"))
    return at.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("n", "mean", "low", "high")], *picks)


def suppression(points: DataFrame, p: str = "p") -> DataFrame:
    """(p, d_low, d_high, lambda, lambda_err) between consecutive distances; nulls where a rate is 0."""
    w = Window.partitionBy(p).orderBy("distance")
    rows = points.select(p, F.col("distance").alias("d_low"), "ler", (F.col("ci_high") - F.col("ci_low")).alias("width"), F.lead("distance").over(w).alias("d_high"), F.lead("ler").over(w).alias("ler_high"), F.lead(F.col("ci_high") - F.col("ci_low")).over(w).alias("width_high")).filter("d_high IS NOT NULL")
    ok = (F.col("ler") > 0) & (F.col("ler_high") > 0)
    ratio = F.when(ok, F.col("ler") / F.col("ler_high"))
    relative = F.sqrt(F.pow(F.col("width") / (2 * F.col("ler")), F.lit(2)) + F.pow(F.col("width_high") / (2 * F.col("ler_high")), F.lit(2)))
    return rows.select(p, "d_low", "d_high", ratio.alias("lambda"), F.when(ok, ratio * relative).alias("lambda_err"))


def dual_points(rows: DataFrame) -> DataFrame:
    """rows (.., rounds, shots, x_errors, z_errors, combined_errors) with their rates."""
    return rows.select("*", *[rate(F.col(f"{k}_errors"), F.col("shots"), F.col("rounds")).alias(f"{k}_ler") for k in ("x", "z", "combined")])


def solved_percent(defects: Column, remaining: Column) -> Column:
    """Share of defects that are gone, in percent; 100 without defects."""
    return F.when(defects > 0, (1 - remaining / defects) * 100).otherwise(100.0)


def parity(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(both, ours_only, theirs_only, neither): shots that two decoders' results (shot_id, resolved) clear."""
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    rows = ours.select("shot_id", F.col("resolved").alias("a")).join(theirs.select("shot_id", F.col("resolved").alias("b")), "shot_id", "full")
    return rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("ours_only"), F.count_if(~a & b).alias("theirs_only"), F.count_if(~a & ~b).alias("neither"))
