"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `radius` differing bits are linked; a document's group is its connected component.
Bits that go together are grouped into parts. With part thresholds t_i >= -1 and sum(t_i + 1) = radius + 1,
two linked fingerprints differ in at most t_i bits in some part, so probing each part within its own
threshold finds every link. Dynamic programming picks the thresholds with the fewest estimated candidates.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, minhash
from .components import connected, local_roots
from .pivots import linked

BITS = 64
#: Cost of a shuffled probe row, in units of a compared pair.
ROW_COST = 100.0
#: Near duplicates: the SimHash radius and words that find most of them; MinHash bands find the rest.
NEAR_RADIUS, NEAR_SIMHASH_WORDS = 6, 2
#: Entries of one bucket that a task compares as a whole; larger buckets are split into blocks.
BLOCK = 4096


def simhash(text: str | None, n: int = 4) -> int:
    """Majority bits of the shingles' XXH64; zero without words, one shingle below n words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: 1 - n].tolist(), ends[n - 1 :].tolist(), strict=True)] if n > 1 else [xxhash.xxh64_intdigest(w, 42) for w in words]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash_udf(n: int = 4):
    """Column function text -> fingerprint as a signed bigint."""

    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(x, n) for x in texts.to_pylist()], np.uint64).view(np.int64))

    return fp


def bit_counts(fps: DataFrame, col: str = "fp") -> tuple[int, np.ndarray]:
    """Number of rows and the 64 x 64 matrix of rows in which both bits are set, over all rows."""

    def count(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, BITS)), pa.array(np.append(j, BITS)), pa.array(np.append(total[i, j], n).astype(np.int64))], ["i", "j", "n"])

    rows = fps.select(F.col(col)).mapInArrow(count, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, c in rows:
        if i == BITS:
            n = int(c)
        else:
            both[i, j] = both[j, i] = c
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, correlated bits together (greedy by correlation)."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, groups = list(range(BITS)), []
    for size in [BITS // parts + (k < BITS % parts) for k in range(parts)]:
        rest = np.array(left)
        sub = corr[np.ix_(rest, rest)] - np.eye(len(rest))
        group = [left[int(np.argmax(sub.max(1)))]]
        while len(group) < size:
            cand = [b for b in left if b not in group]
            group.append(max(cand, key=lambda b: (corr[b, group].mean(), -b)))
        left = [b for b in left if b not in group]
        groups.append(sorted(group))
    return groups


def estimates(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated cost of a part for thresholds -1 to most: candidate pairs plus probe rows.

    Pairs differ in a bit with 2p(1-p); the count of differing bits is taken as independent, raised to the
    pairwise correlation's excess of agreement, from statistics over all fingerprints.
    """
    p = np.diag(both)[group] / max(n, 1)
    differ = 2 * p * (1 - p)
    dist = np.zeros(most + 2)
    dist[0] = 1.0
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    cov = both[np.ix_(group, group)] / max(n, 1) - np.outer(p, p)
    excess = 1.0 + 4 * float((np.triu(cov, 1) ** 2 / np.maximum(np.outer(1 - differ, 1 - differ), 1e-9)).sum())
    pairs = np.cumsum(dist)[: most + 1] * n * n / 2 * excess
    rows = [n * sum(math.comb(len(group), k) for k in range(t + 1)) / (2 if t else 1) for t in range(most + 1)]
    return [0.0] + [float(c) + ROW_COST * r for c, r in zip(pairs, rows, strict=True)]


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds (t_i >= -1, sum of t_i + 1 equal to radius + 1) of least total cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, picked) in best.items():
            for take in range(min(len(cost), radius + 2 - used)):
                new = (total + cost[take], [*picked, take - 1])
                if used + take not in step or new[0] < step[used + take][0]:
                    step[used + take] = new
        best = step
    return best[radius + 1]


def plan(fps: DataFrame, radius: int, col: str = "fp", parts: range = range(2, 9), max_threshold: int = 3) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds for these fingerprints."""
    n, both = bit_counts(fps, col)
    found = None
    for m in parts:
        if m * (max_threshold + 1) < radius + 1:
            continue
        groups = group_bits(n, both, m)
        total, thresholds = allocate([estimates(n, both, g, max_threshold) for g in groups], radius)
        if found is None or total < found[0]:
            found = (total, groups, thresholds)
    return found[1], found[2]


def _gather(x: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for k, bit in enumerate(group):
        out |= ((x >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def probes(fps: DataFrame, groups: list[list[int]], thresholds: list[int], col: str = "fp") -> DataFrame:
    """Rows (part, key, fp, probe): each value of a part, and its larger variants within the threshold.

    Of two values that differ, the smaller one's probes meet the larger one, so each link shows once.
    """

    def run(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for part, (group, t) in enumerate(zip(groups, thresholds, strict=True)):
                if t < 0:
                    continue
                own = _gather(x, group)
                for flips in itertools.chain.from_iterable(itertools.combinations(range(len(group)), k) for k in range(t + 1)):
                    mask = np.uint64(sum(1 << b for b in flips))
                    key = own ^ mask
                    keep = key > own if flips else slice(None)
                    if len(key := key[keep]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), part, np.int32)), pa.array(key.view(np.int64)), pa.array(x[keep].view(np.int64)), pa.array(np.full(len(key), bool(flips)))], ["part", "key", "fp", "probe"])

    return fps.select(F.col(col)).mapInArrow(run, "part int, key bigint, fp bigint, probe boolean")


def _verified(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the given links as (node, root)."""
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.uint64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.uint64)
    return local_roots(a.view(np.int64), b.view(np.int64))


def _within_groups(gid: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal gid (sorted), by comparing each row with its k-th successor."""
    found, size, active, k = [], 0, np.arange(len(gid)), 1
    while len(active):
        active = active[active + k < len(gid)]
        active = active[gid[active] == gid[active + k]]
        a, b = fp[active], fp[active + k]
        hit = (a != b) & ~(probe[active] & probe[active + k]) & _verified(a, b, radius)
        if hit.any():
            found.append((a[hit], b[hit]))
            size += int(hit.sum())
            if size > 1 << 20:
                u, v = _edges(found)
                found, size = [(u.view(np.uint64), v.view(np.uint64))], len(u)
        k += 1
    return _edges(found)


def link_buckets(radius: int):
    """Function over Arrow batches sorted by (part, key): the verified links of each bucket, as a forest."""

    def run(batches):
        held: list[np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                part, key, fp, probe = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                cols = [part.astype(np.int64), key.astype(np.int64), fp.astype(np.int64).view(np.uint64), probe.astype(bool)]
                if held is not None:
                    cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            elif held is None:
                return
            else:
                cols = held
            new = np.empty(len(cols[0]), bool)
            new[0] = True
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            if batch is not None:  # the last bucket may go on in the next batch
                cut = int(np.flatnonzero(new)[-1])
                held = [x[cut:] for x in cols]
                cols, new = [x[:cut] for x in cols], new[:cut]
            if len(new):
                u, v = _within_groups(np.cumsum(new), cols[2], cols[3], radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _by_block(batches, columns: int):
    """(rows of one block after the other), each a list of columns, from Arrow batches sorted by their first column."""
    held: list[list] = []
    block = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.array(batch.column(0).to_pylist(), object)
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, columns + 1)]
        starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for i, j in zip(starts, starts[1:]):
            if names[i] != block and held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            block = names[i]
            held.append([c[i:j] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def link_blocks(radius: int):
    """Function over Arrow batches (block, side, fp, probe) sorted by block: links of side 0 with side 1, as a forest."""

    def run(batches):
        for side, fp, probe in _by_block(batches, 3):
            fp, probe = fp.astype(np.int64).view(np.uint64), probe.astype(bool)
            found = []
            a, pa_, b, pb = fp[side == 0], probe[side == 0], fp[side == 1], probe[side == 1]
            for i in range(0, len(a), 256):
                x = a[i : i + 256, None]
                hit = _verified(x, b[None, :], radius) & (x != b[None, :]) & ~(pa_[i : i + 256, None] & pb[None, :])
                r, c = np.nonzero(hit)
                if len(r):
                    found.append((x[r, 0], b[c]))
                if len(found) > 16:
                    u, v = _edges(found)
                    found = [(u.view(np.uint64), v.view(np.uint64))]
            # one side 0 row is a pivot: its links are kept as they are
            u, v = (found[0][0].view(np.int64), found[0][1].view(np.int64)) if len(a) == 1 and found else _edges(found)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _central(rows: DataFrame) -> DataFrame:
    """(part, key, size, pivot): of each bucket the fingerprint nearest to its bitwise majority, among those in their own bucket."""
    own = rows.filter("NOT probe")
    ones = own.groupBy("part", "key").agg(F.count("*").alias("n"), *[F.sum(F.shiftright("fp", b).bitwiseAND(1)).alias(f"b{b}") for b in range(BITS)])
    centre = F.lit(0).cast("bigint")
    for b in range(BITS):
        centre = centre.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(0))
    centres = ones.select("part", "key", centre.alias("centre"))
    total = F.col("n").cast("bigint")
    found = common.join_frequent(own, centres.join(ones.select("part", "key", total.alias("of")), ["part", "key"]), ["part", "key"], "of", own.count())
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre")))
    return found.groupBy("part", "key").agg(F.min(F.struct(apart.alias("apart"), F.col("fp").alias("fp"))).alias("m"), F.first("size").alias("size")).select("part", "key", "size", F.col("m.fp").alias("pivot"))


def links(fps: DataFrame, radius: int, col: str = "fp", block: int = BLOCK, thresholds: tuple[list[list[int]], list[int]] | None = None) -> DataFrame:
    """(u, v): links among distinct fingerprints with the same components as all pairs within radius.

    Buckets of up to `block` entries are compared in one task each, larger ones by a pivot and in blocks.
    """
    groups, picked = thresholds or plan(fps, radius, col)
    rows = probes(fps, groups, picked, col)
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("size")).filter(F.col("size") > block)
    hot = common.stored(sizes, "hot-buckets")
    n_hot = hot.count()
    if not n_hot:
        return rows.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(link_buckets(radius), "u bigint, v bigint")
    # hot buckets hold more than `block` rows each: few against all rows, but not bounded, so they aren't broadcast by hand
    plain = rows.join(hot, ["part", "key"], "left_anti")
    out = plain.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(link_buckets(radius), "u bigint, v bigint")
    tagged = common.stored(common.join_frequent(rows, hot.withColumn("of", F.col("size")), ["part", "key"], "of", rows.count()), "hot-rows")
    pivots = common.stored(_central(tagged), "hot-pivots")
    return out.unionByName(linked(tagged, ["part", "key"], "fp", ["fp", "probe"], pivots, link_blocks(radius), block, "hot"))


def components(docs: DataFrame, radius: int = 4, n: int = 4, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id of its component.

    Null and blank texts have fingerprint zero and are linked like any other. Rows with a null id keep it;
    a component of null ids only has a null id. Repeated rows come back as often as they are. An empty table
    gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    base = common.stored(docs.select(F.col(doc_id).alias("doc_id"), simhash_udf(n)(F.col(text)).alias("fp")), "simhash")
    classes = common.stored(base.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "simhash-classes")
    edges = common.stored(links(classes, radius, "fp", block), "simhash-links")
    roots = connected(edges)  # node, root
    tagged = common.stored(classes.join(roots, classes.fp == roots.node).select("fp", "first_id", "root"), "simhash-roots")
    least = common.stored(tagged.groupBy("root").agg(F.min("first_id").alias("component")), "simhash-least")
    moved = tagged.join(least, "root").select("fp", "component")
    of_class = classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "first_id").alias("component_id"), "rows")
    return common.join_frequent(base, of_class, ["fp"], "rows", base.count()).select("doc_id", "fp", "component_id")


def near_groups(docs: DataFrame, threshold: float = minhash.NEAR, n: int = minhash.N_WORDS, radius: int = NEAR_RADIUS, simhash_words: int = NEAR_SIMHASH_WORDS, block: int = minhash.BLOCK) -> DataFrame:
    """(doc_id, text_key, group_id, rep_key): minhash.near_groups with links of SimHash fingerprints as candidates, too.

    Fingerprints over simhash_words-word shingles that differ in `radius` bits or fewer are probed for by the
    generalised pigeonhole principle; a link or an equal fingerprint is a candidate if the MinHash signatures agree.
    """

    def candidates(classes: DataFrame) -> DataFrame:
        reps = common.stored(classes.groupBy("fp").agg(F.min("cid").alias("rep"), F.count("*").alias("of")), "near-fps")
        found = links(reps.select("fp"), radius, "fp")
        u, v = (reps.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "uv")
        pairs = found.join(u, "u").join(v, "v").select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v"))
        same = classes.select("fp", "cid").join(reps.filter("of > 1"), "fp").filter("cid <> rep")
        return pairs.unionByName(same.select(F.col("cid").alias("u"), F.col("rep").alias("v")))

    text = F.coalesce("text", F.lit(""))
    return minhash.near_groups(docs, threshold, n, block, {"fp": simhash_udf(simhash_words)(text)}, candidates)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near_groups, the one with the smallest doc_id.

    Of rows that repeat this id and text one stays; all columns are returned unchanged, whatever their names. Null
    and blank texts are equal; a group of null ids keeps one row; an empty table gives an empty result. The whole
    rows are shuffled once at most, and only repeated rows make them be aggregated.
    """
    found = near_groups(docs, **options)
    rows = found.filter(F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("text_key") == F.col("rep_key")))
    own_key, keep_id, keep_key = common.fresh(docs.columns, "own_key", "keep_id", "keep_key")
    keep = common.stored(rows.groupBy(F.col("doc_id").alias(keep_id), F.col("text_key").alias(keep_key)).agg(F.count("*").alias("n")), "near-kept")
    own = docs.withColumn(own_key, minhash.text_key())
    kept = own.join(keep.select(keep_id, keep_key), F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(own_key) == F.col(keep_key)), "left_semi")
    if not keep.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", own_key])
    return kept.select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = components(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
