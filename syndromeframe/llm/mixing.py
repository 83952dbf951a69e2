"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order by hash, are cut into blocks. With weight w, block i (from 0) of a source
may run from its release floor(i / w) and must have run by its deadline ceil((i + 1) / w), in slots of one
block. Earliest deadline first among the released blocks meets every window, so that in any prefix of the
schedule a source is less than one block off its target. Weights are exact quotients, never rounded; the driver
schedules all blocks, and rows find their slot by their rank. When a source has run out and its next block would
be due, the others go on by their weights in a new phase: no document is lost, and `selected` marks the first
phase, in which all targets hold.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents in a block.
BLOCK_DOCS = 16
#: Default target: each source's share of the documents, but no source above this share while others last.
MOST_SHARE = 0.3
SEED = 11
#: Documents by which ranks are counted in one task: a two-thousandth of all, between these bounds.
BUCKET_DOCS = (500, 20_000)


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportion of the weights (a float is the quotient that it stores)."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    found = {s: int(w * scale) for s, w in exact.items()}
    common_part = math.gcd(*found.values())
    return {s: w // common_part for s, w in found.items()}


def edf(slots: dict[str, int], blocks: dict[str, int] | None = None) -> dict[str, np.ndarray]:
    """Slots of each source's blocks: earliest deadline first among the released, by weights in proportion to slots.

    It ends before the first slot that is due to a block beyond a source's `blocks` (None: those of one period).
    """
    names = sorted(slots)
    weight, supply = [slots[s] for s in names], [(blocks or slots)[s] for s in names]
    total, left = sum(weight), sum(supply)
    out: list[list[int]] = [[] for _ in names]
    ready = [(-(-total // q), k) for k, q in enumerate(weight)]
    heapq.heapify(ready)
    waiting: list[tuple[int, int, int]] = []
    for t in range(left):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        _, k = ready[0]
        i = len(out[k]) + 1
        if i > supply[k]:
            break
        out[k].append(t)
        release, deadline = i * total // weight[k], -(-(i + 1) * total // weight[k])
        if release <= t + 1:
            heapq.heapreplace(ready, (deadline, k))
        else:
            heapq.heappop(ready)
            heapq.heappush(waiting, (release, deadline, k))
    return {s: np.array(v, np.int64) for s, v in zip(names, out, strict=True)}


@dataclass
class Phase:
    """A phase from slot `start`: of the sources that run in it, weights (of `period` in all), slots after the start, and blocks."""

    start: int
    period: int
    slots: dict[str, int]
    order: dict[str, np.ndarray]
    first: dict[str, int]
    last: dict[str, int]


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[Phase]:
    """Phases of the schedule of so many blocks by source; sources without a weight follow at the end by size."""
    left, at, start = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0
    found: list[Phase] = []
    while left:
        slots = whole({s: weights[s] for s in left if weights.get(s, 0) > 0} or left)
        order = edf(slots, {s: left[s] for s in slots}) if len(slots) > 1 else {s: np.arange(left[s]) for s in slots}
        used = {s: len(x) for s, x in order.items() if len(x)}
        found.append(Phase(start, sum(slots.values()), {s: slots[s] for s in used}, {s: order[s] for s in used}, {s: at[s] for s in used}, {s: at[s] + n for s, n in used.items()}))
        for s, n in used.items():
            at[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start += sum(used.values())
    return found


def target_weights(docs_by_source: dict[str, int], most: float = MOST_SHARE) -> dict[str, Fraction]:
    """Exact shares of the documents with none above `most`; the surplus goes to the others in proportion."""
    most = Fraction(str(most))
    share = {s: Fraction(n, max(1, sum(docs_by_source.values()))) for s, n in docs_by_source.items()}
    capped: set[str] = set()
    while len(capped) < len(share):
        rest = sum(share[s] for s in share if s not in capped)
        scale = (1 - most * len(capped)) / rest if rest and most * len(capped) < 1 else 1
        over = {s for s in share if s not in capped and share[s] * scale > most}
        if not over or most * (len(capped) + len(over)) >= 1:
            break
        capped |= over
    rest = sum(share[s] for s in share if s not in capped)
    return {s: most if s in capped else share[s] * (1 - most * len(capped)) / rest for s in share}


def _hash() -> F.Column:
    return F.xxhash64(F.lit(SEED), F.col("doc_id"))


def _key(source: F.Column) -> F.Column:
    """What stands for a source: a null one is no name's equal, not even the empty name's."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _of_key(key: str) -> str | None:
    return key[1:] if key else None


def _slots(plan: list[Phase], source: np.ndarray, rank: np.ndarray, block_docs: int):
    """Block, slot, release, deadline and phase of rows by their source and rank in it."""
    block = rank // block_docs
    slot, release, deadline, phase = (np.zeros(len(rank), np.int64) for _ in range(4))
    for s in set(source):
        mine = np.flatnonzero(source == s)
        for k, p in enumerate(plan):
            if s not in p.slots:
                continue
            here = mine[(block[mine] >= p.first[s]) & (block[mine] < p.last[s])]
            i, q = block[here] - p.first[s], p.slots[s]
            slot[here] = p.start + p.order[s][i]
            exact = i.astype(object)  # products of weights and blocks may exceed 64 bits
            release[here] = p.start + exact * p.period // q
            deadline[here] = p.start - (-(exact + 1) * p.period // q)
            phase[here] = k
    return block, slot, release, deadline, phase


def _place(plan: list[Phase], block_docs: int):
    def run(batches):
        for batch in batches:
            key, rank = np.array(batch.column("key").to_pylist(), object), batch.column("rank").to_numpy()
            block, slot, release, deadline, phase = _slots(plan, key, rank, block_docs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([_of_key(k) for k in key], pa.string()), batch.column("h"), pa.array(block), pa.array(release), pa.array(deadline), pa.array(slot), pa.array(slot * block_docs + rank % block_docs), pa.array(phase == 0)],
                ["doc_id", "source", "h", "block", "release_slot", "deadline_slot", "slot", "position", "selected"],
            )

    return run


def _position_udf(plan: list[Phase], block_docs: int):
    @F.arrow_udf("bigint")
    def position(key: pa.Array, rank: pa.Array) -> pa.Array:
        rank = rank.to_numpy(zero_copy_only=False)
        return pa.array(_slots(plan, np.array(key.to_pylist(), object), rank, block_docs)[1] * block_docs + rank % block_docs)

    return position


def _ranked(rows: DataFrame, weights: dict | None, block_docs: int, key: str, h: str, rank: str, copies: str | None = None) -> tuple[DataFrame, list[Phase]]:
    """rows with the columns key, h and rank (from 0, in each source by hash), and the plan of their blocks.

    copies: a column that says for how many documents a row stands; its rank is the first one's.
    """
    common.small_batches(rows.sparkSession)
    size = F.col(copies) if copies else F.lit(1)
    bucket, before, k = common.fresh([*rows.columns, key, h, rank], "bucket", "before", "k")
    rows = rows.withColumn(key, _key(F.col("source"))).withColumn(h, _hash())
    n = rows.count()
    bits = (n // min(max(n // 2000, BUCKET_DOCS[0]), BUCKET_DOCS[1])).bit_length()
    # A source of any size is ranked over its buckets of the hash's upper bits.
    rows = rows.withColumn(bucket, F.shiftright(F.col(h), 63 - bits))
    counts = common.stored(rows.groupBy(key, bucket).agg(F.sum(size).alias("n")), "mix-counts")
    by_source = {r[key]: r.n for r in counts.groupBy(key).agg(F.sum("n").alias("n")).collect()}
    weights = target_weights(by_source) if weights is None else {"" if s is None else f"={s}": w for s, w in weights.items()}
    plan = phases({s: -(-c // block_docs) for s, c in by_source.items()}, weights)
    first = counts.select(key, bucket, (F.sum("n").over(Window.partitionBy(key).orderBy(bucket)) - F.col("n")).alias(before))
    own = Window.partitionBy(key, bucket).orderBy(h, "doc_id")
    inside = F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)) if copies else F.row_number().over(own) - 1
    # both sides are dealt by source and bucket already; the table of counts grows with the rows and is not broadcast
    ranked = rows.withColumn(k, F.coalesce(inside, F.lit(0))).join(first.hint("merge"), [key, bucket]).withColumn(rank, F.col(before) + F.col(k))
    return ranked.drop(bucket, before, k), plan


#: Equal rows that one row stands for up to here are written out by the task that has it.
COPIES = 100_000


def _scheduled(docs: DataFrame, weights: dict | None, block_docs: int) -> DataFrame:
    # equal rows are one row with a count until they have their places
    rows = common.stored(docs.groupBy("doc_id", "source").agg(F.count("*").alias("copies")), "mix-rows")
    ranked, plan = _ranked(rows, weights, block_docs, "key", "h", "rank", "copies")
    parts = ranked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES))))
    if (rows.agg(F.max("copies")).first()[0] or 0) > COPIES:
        parts = parts.repartition("doc_id", "source", "part")
    last = F.least(F.lit(COPIES).cast("bigint"), F.col("copies") - F.col("part") * COPIES) - 1
    each = parts.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    schema = "doc_id bigint, source string, h bigint, block bigint, release_slot bigint, deadline_slot bigint, slot bigint, position bigint, selected boolean"
    return each.select("doc_id", "key", "h", (F.col("rank") + F.col("part") * COPIES + F.col("copy")).alias("rank")).mapInArrow(_place(plan, block_docs), schema)


def schedule(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, source, block, release_slot, deadline_slot, slot, position, selected) of every row.

    weights: target by source (None: the null source); None: target_weights of the sources' counts. The plan
    holds 8 bytes for each block and is sent to every task. A null source is a source of its own; rows that repeat a
    doc_id, null ids, too, get places of their own; columns other than doc_id and source are ignored; an empty table
    gives an empty result.
    """
    return _scheduled(docs, weights, block_docs).drop("h")


def mixture(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of docs in the first phase, that is as long as every source keeps to its target weight.

    A source's order is by hash, so its rows before the first unselected one are a filter by source and hash. Nulls,
    repeated rows and an empty table as in schedule; columns stay unchanged.
    """
    found = common.stored(_scheduled(docs, weights, block_docs), "mixture")
    cut = {r.key: r.h for r in found.filter("NOT selected").groupBy(_key(F.col("source")).alias("key")).agg(F.min("h").alias("h")).collect()}
    if not cut:
        return docs
    limits = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
    limit = F.try_element_at(limits, _key(F.col("source")))
    return docs.filter(limit.isNull() | (_hash() < limit))


def interleaved(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows of docs in the order of their positions in the schedule, later phases included.

    Partitions are ranges of positions. Whole rows are shuffled twice, by bucket for their ranks and by position. All
    columns stay unchanged, whatever their names; null sources, repeated rows and an empty table as in schedule.
    """
    key, h, rank, position = common.fresh(docs.columns, "key", "h", "rank", "position")
    ranked, plan = _ranked(docs, weights, block_docs, key, h, rank)
    placed = ranked.withColumn(position, _position_udf(plan, block_docs)(key, rank))
    return placed.repartitionByRange(position).sortWithinPartitions(position).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return schedule(common.table(spark, sf_dir, "documents"))
