"""Decoding of defect relations, one row per shot, and its corrections as rows."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.grids import CUSTOM, Grid
from . import kernel, lattice
from .lattice import Adjacency, GraphAdjacency

#: Node slots of all shots that one kernel call handles; large lattices get fewer shots a call.
CHUNK_NODES = 1 << 18
#: Defects up to which a shot counts as sparse.
SPARSE_DEFECTS = 32

#: Rows of one shot beyond which a task folds those that cancel, so that a hot shot is no larger than its lattice.
FOLD_ROWS = 1 << 20

SCHEMA = "shot_id bigint, n_defects int, n_outside int, n_unresolved int, u array<bigint>, v array<bigint>"
#: Columns that `carry` adds: the defects, those that stay open, a bit for each part of the lattice with a toggle, and
#: microseconds of the kernel for a shot of its chunk.
CARRIED = ", defects array<bigint>, open array<bigint>, parts int, decode_us double"


def _lists(shot: np.ndarray, values: pa.Array, shots: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(shot, minlength=shots))]), pa.int32()), values)


def _chunk(adj: Adjacency | GraphAdjacency, keys: np.ndarray, shot: np.ndarray, node: np.ndarray, gone: np.ndarray | None, carry: bool, most: int | None, rules: kernel.Rules, folded: np.ndarray | int = 0) -> pa.RecordBatch:
    """Decoded shots: rows (shot, node) toggle, keys name the shots, gone marks rows that are erasures instead.

    folded: rows outside the lattice, by shot, that are no longer among the rows.
    """
    shots, n_nodes = len(keys), len(adj.public)
    holes = None
    if gone is not None and gone.any():
        hole_shot, hole = shot[gone], adj.to_dense(node[gone])
        holes = hole_shot[hole >= 0], hole[hole >= 0]
        shot, node = shot[~gone], node[~gone]
    dense = adj.to_dense(node)
    inside = dense >= 0
    outside = np.bincount(shot[~inside], minlength=shots) + folded
    flat = np.sort(shot[inside] * n_nodes + dense[inside])
    first = np.flatnonzero(np.diff(flat, prepend=-1))
    times = np.diff(np.append(first, len(flat)))
    s, k = np.divmod(flat[first[times % 2 == 1]], n_nodes)
    count = np.bincount(s, minlength=shots)
    kept, touched = np.arange(shots), np.zeros(shots, np.int32)
    for part, (low, high) in enumerate(adj.spans):
        touched[shot[(node >= low) & (node < high)]] |= 1 << part
    if most is not None:  # dense shots are left out before any of them grows
        sparse = count <= most
        kept, renumber = np.flatnonzero(sparse), np.cumsum(sparse) - 1
        mine = sparse[s]
        s, k = renumber[s[mine]], k[mine]
        if holes is not None:
            mine = sparse[holes[0]]
            holes = renumber[holes[0][mine]], holes[1][mine]
        keys, outside, count, shots = keys[kept], outside[kept], count[kept], len(kept)
    began = time.perf_counter()
    c_shot, c_edge, l_shot, l_node = kernel.decode(adj, s, k, shots, holes, rules)
    took = 1e6 * (time.perf_counter() - began) / max(shots, 1)
    v = adj.v[c_edge]
    u = adj.public[adj.u[c_edge]]
    order = np.lexsort((np.where(v < 0, np.iinfo(np.int64).max, adj.public[np.maximum(v, 0)]), u, c_shot))
    u, v, c_shot = u[order], v[order], c_shot[order]
    far = pa.array(adj.public[np.maximum(v, 0)], mask=v < 0)
    cols = [pa.array(keys), pa.array(count.astype(np.int32)), pa.array(outside.astype(np.int32)), pa.array(np.bincount(l_shot, minlength=shots).astype(np.int32)), _lists(c_shot, pa.array(u), shots), _lists(c_shot, far, shots)]
    names = ["shot_id", "n_defects", "n_outside", "n_unresolved", "u", "v"]
    if carry:
        cols += [_lists(s, pa.array(adj.public[k]), shots), _lists(l_shot, pa.array(adj.public[l_node]), shots), pa.array(touched[kept]), pa.array(np.full(shots, took))]
        names += ["defects", "open", "parts", "decode_us"]
    return pa.RecordBatch.from_arrays(cols, names)


def _fold(adj: Adjacency | GraphAdjacency, node: np.ndarray, gone: np.ndarray | None) -> tuple[np.ndarray, int]:
    """(rows of one shot that stand for all of its rows, rows outside the lattice that they leave out)."""
    code = node * 2 + (gone if gone is not None else 0)
    _, first, times = np.unique(code, return_index=True, return_counts=True)
    outside = (adj.to_dense(node[first]) < 0) & ((gone is None) or ~gone[first])
    # a toggled node keeps its parity and at least one row
    again = first[~outside & (times % 2 == 0)]
    return np.concatenate([first, again]), int((times[outside] - 1).sum())


def _run(adjacency: Callable[[], Adjacency | GraphAdjacency], with_gone: bool, carry: bool, most: int | None, rules: kernel.Rules):
    def run(batches: Iterable[pa.RecordBatch]):
        adj = adjacency()
        limit = max(1, CHUNK_NODES // len(adj.public))
        held: list[np.ndarray] = []
        extra = 0  # rows outside that the first shot held has lost by folding
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(3 if with_gone else 2)]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if not held or not len(held[0]):
                continue
            starts = np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))
            ends = np.append(starts[1:], len(held[0]))
            # the last shot may go on in the next batch, and chunks are filled
            whole = len(starts) if batch is None else (len(starts) - 1) // limit * limit
            for i in range(0, whole, limit):
                j = min(i + limit, whole)
                rows = slice(starts[i], ends[j - 1])
                folded = np.zeros(j - i, np.int64)
                folded[0], extra = (extra, 0) if i == 0 else (0, extra)
                yield _chunk(adj, held[0][starts[i:j]], np.repeat(np.arange(j - i), ends[i:j] - starts[i:j]), held[1][rows], held[2][rows] if with_gone else None, carry, most, rules, folded)
            held = [x[ends[whole - 1] if whole else 0 :] for x in held]
            if len(held[0]) > FOLD_ROWS and held[0][0] == held[0][-1]:
                keep, lost = _fold(adj, held[1], held[2] if with_gone else None)
                held, extra = [x[keep] for x in held], extra + lost

    return run


def decode(defects: DataFrame, grid: Grid, erased: Iterable[int] = (), erasures: DataFrame | None = None, shot: str = "shot_id", node: str = "node", carry: bool = False, most: int | None = None, rules: kernel.Rules = kernel.RULES) -> DataFrame:
    """One row per shot: defects, correction edges (u, v; v null at the boundary; sorted), and what stays open.

    Rows of `defects` toggle: a (shot, node) that occurs an even number of times is no defect. Nodes outside the
    lattice are dropped and counted. erased: nodes missing in every shot; erasures: (shot, node) missing in one.
    The only shuffle puts a shot's rows together. n_unresolved > 0 marks shots that no correction can clear.
    carry: the rows keep their defects, so that verify.carried needs no further shuffle. most: shots with more
    defects are left out before they are decoded. rules: how clusters grow and which node a tree starts from.
    """
    if grid.topology in CUSTOM:
        gone = set(erased)
        usable = lattice.edges(defects.sparkSession, grid).filter(~F.col("u").isin(gone) & (F.col("v").isNull() | ~F.col("v").isin(gone))) if gone else lattice.edges(defects.sparkSession, grid)
        return decode_graph(defects, usable, shot, node, carry, most, rules)
    return _by_shot(_rows(defects, shot, node, erasures), partial(Adjacency, grid, frozenset(int(x) for x in erased)), carry, most, rules)


def _rows(defects: DataFrame, shot: str, node: str, erasures: DataFrame | None = None) -> DataFrame:
    rows = defects.select(F.col(shot).cast("bigint").alias("shot_id"), F.col(node).cast("bigint").alias("node")).filter("shot_id IS NOT NULL AND node IS NOT NULL")
    if erasures is None:
        return rows
    holes = erasures.select(F.col(shot).cast("bigint").alias("shot_id"), F.col(node).cast("bigint").alias("node")).filter("shot_id IS NOT NULL AND node IS NOT NULL")
    return rows.withColumn("gone", F.lit(False)).unionByName(holes.withColumn("gone", F.lit(True)))


def _by_shot(rows: DataFrame, adjacency: Callable[[], Adjacency | GraphAdjacency], carry: bool = False, most: int | None = None, rules: kernel.Rules = kernel.RULES) -> DataFrame:
    run = _run(adjacency, "gone" in rows.columns, carry, most, rules)
    return rows.repartition("shot_id").sortWithinPartitions("shot_id").mapInArrow(run, SCHEMA + CARRIED * carry)


def decode_packed(packed: DataFrame, grid: Grid, erased: Iterable[int] = (), carry: bool = False, most: int | None = None, rules: kernel.Rules = kernel.RULES) -> DataFrame:
    """decode for packed words (shot_id, word_idx, word), one row a shot of arrays: words become nodes in the task.

    Words that bits.pack has dealt by shot stay where they are.
    """
    adjacency, run_chunk = partial(Adjacency, grid, frozenset(int(x) for x in erased)), partial(_chunk, gone=None, carry=carry, most=most, rules=rules)

    def run(batches: Iterable[pa.RecordBatch]):
        adj = adjacency()
        limit = max(1, CHUNK_NODES // len(adj.public))
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                lists = part.column(1)
                n = np.diff(lists.offsets.to_numpy())
                fields = lists.flatten()
                idx, word = (fields.field(j).to_numpy(zero_copy_only=False) for j in range(2))
                bits = np.unpackbits(word.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, bit = np.nonzero(bits)
                shot = np.repeat(np.arange(part.num_rows), n)
                yield run_chunk(adj, part.column(0).to_numpy(), shot[row], idx[row] * 64 + bit)

    words = packed.filter("shot_id IS NOT NULL").groupBy(F.col("shot_id").cast("bigint").alias("shot_id")).agg(F.collect_list(F.struct(F.col("word_idx").cast("bigint").alias("word_idx"), "word")).alias("words"))
    return words.mapInArrow(run, SCHEMA + CARRIED * carry)


def decode_parts(toggles: DataFrame, parts: list[tuple[Grid, frozenset[int]]]) -> DataFrame:
    """(shot_id, part, n_defects, n_unresolved, u, v, defects, decode_us) for toggles (shot_id, part, node) on several small lattices.

    parts: each one's lattice and the nodes that it lacks. All parts of a shot are one disjoint graph, so that one
    shuffle and one decoding serve them all; a part without a toggle has no row.
    """
    spans = lattice.spans([g for g, _ in parts])
    low = F.element_at(F.array(*[F.lit(a).cast("bigint") for a, _ in spans]), F.col("part") + 1)
    nodes = toggles.filter((F.col("node") >= 0) & (F.col("part") >= 0) & (F.col("part") < len(parts))).select("shot_id", (F.col("node") + low).alias("node"))
    found = _by_shot(_rows(nodes, "shot_id", "node"), partial(lattice.UnionAdjacency, tuple(parts)), True)
    rows = [F.when(F.getbit("parts", F.lit(k)) == 1, _part(k, a, b)) for k, (a, b) in enumerate(spans)]
    return found.select("shot_id", "decode_us", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("shot_id", "r.*", "decode_us")


def _part(k: int, low: int, high: int) -> F.Column:
    """What a decoded row of several lattices holds of lattice k, whose ids are [low, high)."""

    def own(name: str):
        return F.transform(F.filter(name, lambda x: (x >= low) & (x < high)), lambda x: x - low)

    edges = F.filter(F.arrays_zip("u", "v"), lambda e: (e["u"] >= low) & (e["u"] < high))
    u, v = F.transform(edges, lambda e: e["u"] - low), F.transform(edges, lambda e: e["v"] - low)
    return F.struct(F.lit(k).alias("part"), F.size(own("defects")).alias("n_defects"), F.size(own("open")).alias("n_unresolved"), u.alias("u"), v.alias("v"), own("defects").alias("defects"))


def decode_graph(defects: DataFrame, edges: DataFrame, shot: str = "shot_id", node: str = "node", carry: bool = False, most: int | None = None, rules: kernel.Rules = kernel.RULES) -> DataFrame:
    """As decode on any graph: edges (edge_id, u, v), v null at the boundary, for instance a user's lattice.

    The graph is a fixed relation of the code and is sent to every task.
    """
    found = sorted((r.edge_id, r.u, -1 if r.v is None else r.v) for r in edges.select("edge_id", "u", "v").collect())
    u, v = (np.array([f[k] for f in found], np.int64) for k in (1, 2))
    return _by_shot(_rows(defects, shot, node), partial(GraphAdjacency, u, v), carry, most, rules)


def model_edges(mechanisms: DataFrame) -> DataFrame:
    """(edge_id, u, v, frame) of an error model's mechanisms with one or two detectors.

    Parallel mechanisms become one edge, that of the likeliest (then first) one; mechanisms with more detectors
    need a decomposition and are left out: unsupported(mechanisms) lists them.
    """
    n = F.size("detectors")
    e = mechanisms.filter((n == 1) | (n == 2)).select("mech_id", "p", "frame", F.get("detectors", F.lit(0)).alias("u"), F.when(n == 2, F.get("detectors", F.lit(1))).alias("v"))
    best = e.groupBy("u", "v").agg(F.max_by(F.struct("mech_id", "frame"), F.struct("p", (-F.col("mech_id")).alias("m"))).alias("b"))
    return best.select(F.col("b.mech_id").alias("edge_id"), "u", "v", F.col("b.frame").alias("frame"))


def unsupported(mechanisms: DataFrame) -> DataFrame:
    return mechanisms.filter(F.size("detectors") > 2).select("mech_id", F.lit("unsupported").alias("status"))


def decode_sparse(defects: DataFrame, grid: Grid, most: int = SPARSE_DEFECTS) -> DataFrame:
    """decode for shots of at most `most` defects; others have no row and are not decoded."""
    return decode(defects, grid, most=most)


def corrections(decoded: DataFrame) -> DataFrame:
    """(shot_id, u, v) of every correction edge."""
    return decoded.select("shot_id", F.explode(F.arrays_zip("u", "v")).alias("e")).select("shot_id", "e.u", "e.v")


def frames(decoded: DataFrame, edges: DataFrame) -> DataFrame:
    """(shot_id, predicted) of decoded rows: the XOR of the frames of their edges (u, v, frame), a fixed relation of the model."""
    lut = edges.select("u", "v", "frame")
    chosen = corrections(decoded).alias("c").join(F.broadcast(lut).alias("l"), (F.col("c.u") == F.col("l.u")) & F.col("c.v").eqNullSafe(F.col("l.v")))
    return chosen.select("c.shot_id", "l.frame").groupBy("shot_id").agg(F.bit_xor("frame").alias("predicted"))


def flat_export(decoded: DataFrame) -> DataFrame:
    """(shot_id, edges): u0, v0, u1, v1, .. with 4294967295 for the boundary, as the packed interfaces expect."""
    pair = F.transform(F.arrays_zip("u", "v"), lambda e: F.array(e["u"], F.coalesce(e["v"], F.lit(4294967295))))
    return decoded.select("shot_id", F.flatten(pair).alias("edges"))


def manhattan(paths: DataFrame, grid: Grid, keep: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keep.., u, v) of the unit edges from node a to node b: first along x, then y, then t. Closed form."""
    from ..functions import ids

    ax, ay, at = ids.coord(grid, a)
    bx, by, bt = ids.coord(grid, b)

    def leg(run, base, step):
        return F.transform(run, lambda k: F.struct((base + k * step).alias("u"), (base + (k + 1) * step).alias("v")))

    legs = []
    for start, stop, step, base in ((ax, bx, 1, ids.node(grid, F.lit(0), ay, at)), (ay, by, grid.stride_y, ids.node(grid, bx, F.lit(0), at)), (at, bt, grid.stride_z, ids.node(grid, bx, by, F.lit(0)))):
        low, high = F.least(start, stop), F.greatest(start, stop)
        run = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        legs.append(leg(run, base, step))
    return paths.select(*keep, F.explode(F.concat(*legs)).alias("e")).select(*keep, "e.u", "e.v")


def xor_compact(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges that occur an odd number of times, by keys."""
    return edges.groupBy(*keys).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(*keys)


def ancestors(parents: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor): each node with itself and all nodes above it but the root, for trees up to `depth` deep.

    parents (node, parent), parent = node at a root, is a relation of the lattice. Pointers double in each
    round, so that log2(depth) joins of lattice-sized relations suffice.
    """
    jump = parents.select("node", F.col("parent").alias("up"))
    found = parents.filter("node <> parent").select("node", F.col("node").alias("ancestor"))
    reach = 1
    while reach <= depth:
        above = found.select(F.col("node").alias("up"), "ancestor")
        found = found.unionByName(jump.join(above, "up").select("node", "ancestor")).distinct()
        jump = jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))
        reach *= 2
    return found


def path_marks(defects: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """(shot_id, node): nodes on the root paths of an odd number of a shot's defects, roots excluded."""
    return xor_compact(defects.join(F.broadcast(ancestors(parents, depth)), "node").select("shot_id", F.col("ancestor").alias("node")), ["shot_id", "node"])
