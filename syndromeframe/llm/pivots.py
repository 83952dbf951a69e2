"""Links inside buckets too large for one task, without meeting all pairs of a bucket.

One member of a bucket is its pivot. Every member meets the pivot first, in blocks of bounded size; those that link
to it hang together through it, so links among them add nothing to a component. Only members that don't link to the
pivot meet all members, again in blocks. The components are those of all links, and a bucket of copies of one
text costs about one comparison a member.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _chunks(rows: DataFrame, keys: list[str], ident: str, block: int) -> DataFrame:
    """rows with `c`, a chunk of about `block` members of a bucket, of `s` chunks."""
    s = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    return rows.withColumn("s", s).withColumn("c", F.pmod(F.xxhash64(F.lit(17), ident), F.col("s")).cast("int"))


def _run(parts: list[DataFrame], payload: list[str], compare: Callable, tag: str) -> DataFrame:
    both = parts[0].unionByName(parts[1])
    return common.stored(both.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "u bigint, v bigint"), tag)


def linked(rows: DataFrame, keys: list[str], ident: str, payload: list[str], pivots: DataFrame, compare: Callable, block: int, tag: str) -> DataFrame:
    """(u, v): links of the buckets' members, with the same components as all links.

    rows: keys.., size (of the bucket), ident and payload; pivots: keys.., pivot (an ident of the bucket; a bucket
    without one has no links), size. compare: Arrow batches (block, side, payload..) sorted by block to (u, v)
    in idents, where side 0 meets side 1 and a row doesn't link to its own ident.
    """
    total = rows.count()
    whole = common.stored(common.join_frequent(rows.drop("size"), pivots.withColumn("of", F.col("size")), keys, "of", total), f"{tag}-hot")
    dealt = _chunks(whole, keys, ident, block)

    def at(*parts):
        return F.concat_ws(":", *[F.col(k).cast("string") for k in keys], *parts).alias("block")

    members = dealt.select(at(F.lit("p"), "c"), F.lit(1).alias("side"), *payload)
    centres = dealt.filter(F.col(ident) == F.col("pivot")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select(at(F.lit("p"), "d"), F.lit(0).alias("side"), *payload)
    first = _run([members, centres], payload, compare, f"{tag}-pivot")
    ends = first.unionByName(first.select(F.col("v").alias("u"), F.col("u").alias("v"))).select(F.col("u").alias(ident), F.col("v").alias("pivot")).distinct()
    left = common.stored(whole.filter(F.col(ident) != F.col("pivot")).join(ends, [ident, "pivot"], "left_anti"), f"{tag}-left")
    if left.isEmpty():
        return first
    rest = left.groupBy(*keys).agg(F.count("*").alias("n"))
    rest = rest.join(pivots.select(*keys, "size"), keys).withColumnRenamed("size", "of")
    again = common.join_frequent(whole, rest, keys, "of", total)
    # each of the l chunks of what is left meets each of the s chunks of the bucket
    l_chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    everyone = _chunks(again, keys, ident, block).withColumn("d", F.explode(F.sequence(F.lit(0), l_chunks - 1))).select(at(F.lit("l"), "d", "c"), F.lit(1).alias("side"), *payload)
    counted = common.join_frequent(left, rest, keys, "of", total)
    mine = _chunks(counted, keys, ident, block).withColumn("l", F.pmod(F.xxhash64(F.lit(23), ident), l_chunks).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select(at(F.lit("l"), "l", "d"), F.lit(0).alias("side"), *payload)
    return first.unionByName(_run([mine, everyone], payload, compare, f"{tag}-rest"))
