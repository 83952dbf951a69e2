"""MinHash fingerprints over word shingles, their likeness, and near-duplicate classes by signature bands.

A text's shingles are runs of n white-space separated words (fewer words: the whole sequence). Each of K
permutations x -> (a x + b) mod 2^32 with odd a keeps its least image; 16 mixed bits of each minimum form
the signature. Texts without words share one signature of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectext
from .components import connected, local_roots
from .pivots import linked

K = 128
N_WORDS = 5
SEED = 7
BANDS, ROWS = 25, 5
#: Near duplicates: Jaccard similarity of the sets of N_WORDS-word shingles.
NEAR = 0.8
#: Signatures of a similar pair agree by this less than its similarity at worst (over four deviations at 0.8).
AGREE_SLACK = 0.15
#: Texts of a bucket or a candidate component that a task compares as a whole; larger ones go by a pivot and in blocks.
BLOCK = 512
#: Candidate classes (400 bytes each) up to which they are broadcast to find their texts; beyond it they are joined.
BROADCAST_CLASSES = 20_000
#: Shingles permuted at once, so that a permutation's images stay in the cache.
_STEP = 1 << 17


def permutations(k: int = K, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, k, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, np.uint32)


def shingle_hashes(texts: pa.Array, n: int = N_WORDS):
    """(first row, end row, 64-bit shingle hashes, shingles of each row), chunk by chunk."""
    for row, end, buf, offs in vectext.chunks(texts):
        starts, ends, per_doc = vectext.doc_words(buf, offs)
        hashes, counts = vectext.shingles(vectext.span_hashes(buf, starts, ends), per_doc, n)
        yield row, end, hashes, counts


def signatures(texts: pa.Array, n: int = N_WORDS, k: int = K, seed: int = SEED) -> np.ndarray:
    """(rows, k) signature of 16-bit values."""
    a, b = permutations(k, seed)
    out = np.full((len(texts), k), 0xFFFFFFFF, np.uint32)
    for row, end, hashes, counts in shingle_hashes(texts, n):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        doc = np.repeat(np.arange(row, end), counts)
        for i in range(0, len(x), _STEP):
            part, owner = x[i : i + _STEP], doc[i : i + _STEP]
            at = np.flatnonzero(np.diff(owner, prepend=-1))
            rows = owner[at]
            for j in range(k):
                low = np.minimum.reduceat(part * a[j] + b[j], at)
                out[rows, j] = np.minimum(out[rows, j], low)
    return ((out ^ (out >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values of two sets of signatures: the estimate of the Jaccard similarity."""
    return (a == b).mean(1) if len(a) else np.zeros(0)


def to_bytes(sig: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in sig.astype(">u2")]


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first code points of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_DIGEST = "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _digest(ids: list, texts: list[str], following: list[str]) -> dict:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    n = len(texts)
    sig = signatures(pa.array([*texts, *changed], pa.large_string()))
    last = signatures(pa.array(following[-1:], pa.large_string()))
    nxt = np.concatenate([sig[1:n], last]) if following[:-1] == texts[1:] else signatures(pa.array(following, pa.large_string()))
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": [hashlib.sha256(c.encode()).digest() for c in changed],
        "fingerprint": to_bytes(sig[:n]),
        "edited_fingerprint": to_bytes(sig[n:]),
        "near_edited": likeness(sig[:n], sig[n:]),
        "near_next": likeness(sig[:n], nxt),
    }


def _along(batches):
    """Digests of neighbouring rows; a partition's first and last rows come back for its neighbours."""
    pid = TaskContext.get().partitionId()
    held: tuple | None = None

    def edge(kind, row):
        return pa.RecordBatch.from_pylist([{"kind": kind, "pid": pid, "text": row[1], "doc_id": row[0]}], pa.schema(_FIELDS))

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        if not ids:
            continue
        if held is None:
            yield edge("first", (ids[0], texts[0]))
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = (ids[-1], texts[-1])
        at = 0
        while at < len(ids) - 1:  # by text size, as one row may be long
            end, size = at, 0
            while end < len(ids) - 1 and (end == at or size < vectext.CHUNK_BYTES):
                size += len(texts[end])
                end += 1
            found = _digest(ids[at:end], texts[at:end], texts[at + 1 : end + 1])
            m = end - at
            found = {"kind": pa.array(["row"] * m), "pid": pa.array([pid] * m, pa.int32()), "text": pa.nulls(m, pa.string())} | found
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in _FIELDS], schema=pa.schema(_FIELDS))
            at = end
    if held is not None:
        yield edge("last", held)


_FIELDS = [pa.field("kind", pa.string()), pa.field("pid", pa.int32()), pa.field("text", pa.string()), pa.field("doc_id", pa.int64()), pa.field("n_chars", pa.int64()), pa.field("edited_sha256", pa.binary()), pa.field("fingerprint", pa.binary()), pa.field("edited_fingerprint", pa.binary()), pa.field("near_edited", pa.float64()), pa.field("near_next", pa.float64())]


def _joined(batches):
    for batch in batches:
        ids, texts, following = (batch.column(k).to_pylist() for k in range(3))
        for i in range(len(ids)):
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in _digest(ids[i : i + 1], [texts[i] or ""], [following[i] or ""]).items()})


def neighbour_digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness, by descending doc_id.

    Null texts count as empty, null ids come last, and rows that repeat an id follow each other by the hash
    of their text. The row after the last is the first, a single row is its own successor; an empty table
    gives an empty result. Texts are shuffled once, by ranges of doc_id, and each row meets its successor
    in a stream over the sorted partition; only a first and a last row per partition are joined afterwards.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"kind string, pid int, text string, {_DIGEST}"
    found = common.stored(rows.mapInArrow(_along, schema), "minhash")
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    pids = sorted(r.pid for r in found.filter("kind = 'first'").select("pid").collect())
    after = spark.createDataFrame([(p, pids[(i + 1) % len(pids)]) for i, p in enumerate(pids)], "pid int, next_pid int")
    firsts = found.filter("kind = 'first'").select(F.col("pid").alias("next_pid"), F.col("text").alias("following"))
    lasts = found.filter("kind = 'last'").select("pid", "doc_id", "text").join(after, "pid").join(firsts, "next_pid")
    ends = lasts.select("doc_id", "text", "following").mapInArrow(_joined, _DIGEST)
    rows = found.filter("kind = 'row'").select(names).unionByName(ends)
    binary = ("edited_sha256", "fingerprint", "edited_fingerprint")  # half the size of hex while stored
    return rows.select([F.lower(F.hex(c)).alias(c) if c in binary else F.col(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    return neighbour_digests(common.table(spark, sf_dir, "documents"))


# --- near-duplicate classes ---------------------------------------------------------------------------------------


def signature_udf(n: int = N_WORDS):
    """Column function text -> signature (A-Z in lower case), two bytes a permutation."""

    @F.arrow_udf("binary")
    def sig(texts: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in signatures(pc.ascii_lower(pc.fill_null(texts, "")), n)], pa.binary())

    return sig


def text_key() -> F.Column:
    """16 bytes that name a text; a null text is empty."""
    return F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))


def band_keys(raw: list[bytes]):
    """64-bit keys of signatures, band by band."""
    sig = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), K)
    for band in range(BANDS):
        part = sig[:, band * ROWS : (band + 1) * ROWS].astype(np.uint64)
        key = np.full(len(sig), band + 1, np.uint64)
        for k in range(ROWS):
            key = vectext.mix(key * np.uint64(0xF1357AEA2E62A9C5) + part[:, k])
        yield key


def _band_rows(batches):
    """Arrow batches (cid, sig) -> (key, cid), one row a band."""
    for batch in batches:
        for key in band_keys(batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["key", "cid"])


def _by_block(batches):
    """Lists of the rows of one block after the other, from Arrow batches sorted by their first column."""
    block, rows = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for now, *row in zip(*cols, strict=True):
            if now != block and rows:
                yield rows
                rows = []
            block = now
            rows.append(row)
    if rows:
        yield rows


def _forest(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    if not found:
        return None
    u, v = local_roots(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]) if len(u) else None


def _agreeing(floor: float):
    """Arrow batches (block, side, cid, sig) sorted by block: links (u, v) of signatures that agree in `floor` or more.

    Side 0 meets side 1, or itself where there is no side 1.
    """

    def run(batches):
        for rows in _by_block(batches):
            if len(rows) < 2:
                continue
            side, cid = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
            sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), K)
            left, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found, size = [], 0
            for i in left:
                cand = other if len(other) else left[left > i]
                hit = cand[(sig[cand] == sig[i]).mean(1) >= floor]
                hit = hit[cid[hit] != cid[i]]
                if len(hit):
                    found.append((np.full(len(hit), cid[i]), cid[hit]))
                    size += len(hit)
                if size > 1 << 18 and len(left) > 1:
                    batch = _forest(found)
                    found, size = [(batch.column(0).to_numpy(), batch.column(1).to_numpy())], batch.num_rows
            if len(left) == 1 and found:  # a pivot: its links as they are
                yield pa.RecordBatch.from_arrays([pa.array(found[0][1]), pa.array(found[0][0])], ["u", "v"])
            elif batch := _forest(found):
                yield batch

    return run


def band_links(classes: DataFrame, floor: float, block: int = BLOCK) -> DataFrame:
    """(u, v): links among classes (cid, sig) that share a band and agree in `floor` of the signature.

    Buckets beyond `block` classes go by a pivot, the class with most company in all its buckets. Only classes that
    share a band carry their signature.
    """
    rows = common.stored(classes.select("cid", "sig").mapInArrow(_band_rows, "key bigint, cid bigint"), "near-bands")
    sizes = common.stored(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").withColumn("of", F.col("size")), "near-band-sizes")
    shared = common.stored(common.join_frequent(rows, sizes, ["key"], "of", rows.count()).select("key", "cid", "size"), "near-shared")
    signed = classes.select("cid", "sig")
    plain = shared.filter(F.col("size") <= block).join(signed, "cid").select(F.col("key").cast("string").alias("block"), F.lit(0).alias("side"), "cid", "sig")
    out = plain.repartition("block").sortWithinPartitions("block").mapInArrow(_agreeing(floor), "u bigint, v bigint")
    if sizes.filter(F.col("size") > block).isEmpty():
        return out
    hot = shared.filter(F.col("size") > block)
    weight = shared.groupBy("cid").agg(F.sum("size").alias("weight"))
    pivots = hot.join(weight, "cid").groupBy("key").agg(F.max(F.struct("weight", (-F.col("cid")).alias("c"))).alias("m"), F.first("size").alias("size"))
    pivots = common.stored(pivots.select("key", "size", (-F.col("m.c")).alias("pivot")), "near-band-pivots")
    return out.unionByName(linked(hot.join(signed, "cid"), ["key"], "cid", ["cid", "sig"], pivots, _agreeing(floor), block, "near-band"))


def agreeing_pairs(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """The pairs (u, v) of classes (cid, sig) whose signatures agree in `floor` or more; v may be a hub."""
    signed = common.stored(pairs.distinct().join(classes.select(F.col("cid").alias("u"), F.col("sig").alias("a")), "u"), "near-pairs")

    @F.arrow_udf("boolean")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), K) for c in (a, b))
        return pa.array((x == y).mean(1) >= floor)

    # two plain shuffles: Spark splits what a hub swells
    return signed.join(classes.select(F.col("cid").alias("v"), F.col("sig").alias("b")), "v").filter(agree("a", "b")).select("u", "v")


def _shingle_sets(n: int):
    """Arrow batches (comp, size, cid, sig, text) -> with the sorted distinct hashes of the text's shingles instead."""

    def run(batches):
        for batch in batches:
            lower = pc.ascii_lower(pc.fill_null(batch.column(4), ""))
            for row, end, hashes, counts in shingle_hashes(lower, n):
                stops = np.cumsum(counts)
                found = [np.unique(hashes[stop - c : stop]).tobytes() for stop, c in zip(stops, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(row, end - row) for k in range(4)], pa.array(found, pa.binary())], ["comp", "size", "cid", "sig", "shingles"])

    return run


def jaccard_reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches threshold; two empty sets are alike."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both)


def _similar(threshold: float):
    """Arrow batches (block, side, cid, sig, shingles) sorted by block: forests (u, v) of the pairs that are similar.

    Side 0 meets side 1, or itself where there is no side 1. Looked at are pairs whose signatures agree enough, the
    likeliest first; pairs that earlier ones have joined aren't looked at again.
    """
    floor = threshold - AGREE_SLACK

    def run(batches):
        for rows in _by_block(batches):
            if len(rows) < 2:
                continue
            side, cid = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
            sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), K)
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            left, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            parent = list(range(len(rows)))

            def find(k, parent=parent):
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            out = []
            for i in left:
                cand = other if len(other) else left[left > i]
                agree = (sig[cand] == sig[i]).mean(1)
                order = np.argsort(-agree, kind="stable")
                for j in cand[order[: int((agree >= floor).sum())]]:
                    a, b = find(i), find(j)
                    if a != b and cid[i] != cid[j] and jaccard_reaches(sets[i], sets[j], threshold):
                        parent[a] = b
                        out.append((cid[i], cid[j]))
            if out:
                u, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def near_groups(docs: DataFrame, threshold: float = NEAR, n: int = N_WORDS, block: int = BLOCK, more: dict | None = None, candidates=None) -> DataFrame:
    """(doc_id, text_key, group_id, rep_key) of every row: groups of texts with similar shingle sets.

    Equal texts are one class and one row of the search. Candidates are classes that share one of the signature's
    bands (any pair at 0.8 with probability 0.9999) and agree in threshold - AGREE_SLACK of it; `candidates`, a
    function of the classes (cid, sig and the columns that `more` adds), may give further pairs, which must agree
    likewise. Within components of candidates, classes are linked if the Jaccard similarity of their whole shingle
    sets (A-Z in lower case) is `threshold` or more, and a group is a component of links. group_id is the smallest
    doc_id of the group, rep_key names its text. Null and blank texts are equal; rows that repeat an id belong to
    the groups of their texts; a null id is no smallest id, a group of null ids has a null group_id. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    floor, more = threshold - AGREE_SLACK, more or {}
    base = common.stored(docs.select("doc_id", text_key().alias("text_key"), signature_udf(n)(F.col("text")).alias("sig"), *[c.alias(name) for name, c in more.items()]), "near")
    counted = base.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("sig", *more)])
    classes = common.stored(counted.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    edges = band_links(classes, floor, block)
    if candidates is not None:
        edges = edges.unionByName(agreeing_pairs(candidates(classes), classes, floor))
    edges = common.stored(edges, "near-links")
    roots = connected(edges)
    comps = common.stored(classes.join(roots.withColumnRenamed("node", "cid"), "cid").select("cid", "sig", "text_key", "first_id", F.col("root").alias("comp")), "near-components")
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size")).withColumn("of", F.col("size"))
    wanted = common.stored(common.join_frequent(comps, sizes, ["comp"], "of", comps.count()), "near-candidates")
    named = wanted.withColumnsRenamed({"first_id": "id", "text_key": "key"})
    if wanted.count() <= BROADCAST_CLASSES:
        named = F.broadcast(named)
    whole = docs.select("doc_id", "text", text_key().alias("own_key"))
    found = whole.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key"))).select("comp", "size", "cid", "sig", "text")
    sets = common.stored(found.mapInArrow(_shingle_sets(n), "comp bigint, size bigint, cid bigint, sig binary, shingles binary"), "near-sets")
    # rows that repeat an id and text come more than once; one stays
    small = sets.filter(F.col("size") <= block).select(F.col("comp").cast("string").alias("block"), F.lit(0).alias("side"), "cid", "sig", "shingles")
    same = small.repartition("block").sortWithinPartitions("block", "cid").mapInArrow(_similar(threshold), "u bigint, v bigint")
    if not sets.filter(F.col("size") > block).isEmpty():
        large = sets.filter(F.col("size") > block).dropDuplicates(["cid"])
        degree = edges.select(F.explode(F.array("u", "v")).alias("cid")).groupBy("cid").agg(F.count("*").alias("weight"))
        pivots = wanted.filter(F.col("size") > block).join(degree, "cid").groupBy("comp").agg(F.max(F.struct("weight", (-F.col("cid")).alias("c"))).alias("m"), F.first("size").alias("size"))
        pivots = common.stored(pivots.select("comp", "size", (-F.col("m.c")).alias("pivot")), "near-pivots")
        same = same.unionByName(linked(large, ["comp"], "cid", ["cid", "sig", "shingles"], pivots, _similar(threshold), block, "near-large"))
    roots = connected(common.stored(same, "near-verified"))
    tagged = common.stored(classes.join(roots, classes.cid == roots.node).select("text_key", "first_id", "root"), "near-roots")
    best = common.stored(tagged.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id"), F.col("text_key"))).alias("b")), "near-best")
    moved = tagged.join(best, "root").select("text_key", F.col("b.first_id").alias("group"), F.col("b.text_key").alias("rep"))
    of_class = classes.select("text_key", "first_id", "rows").join(moved, "text_key", "left").select("text_key", F.coalesce("group", "first_id").alias("group_id"), F.coalesce("rep", "text_key").alias("rep_key"), "rows")
    return common.join_frequent(base.select("doc_id", "text_key"), of_class, ["text_key"], "rows", base.count())
