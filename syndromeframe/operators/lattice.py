"""Nodes and edges of lattices as relations.

Every undirected edge appears once with u < v and an edge_id by (u, v); a boundary edge has a null v, one for
each side of the lattice that its node lies on, after the interior edges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.grids import CUSTOM, Grid

#: User-supplied lattices: name -> function (spark, grid) -> DataFrame(u, v).
REGISTRY: dict[str, Callable[[SparkSession, Grid], DataFrame]] = {}


def register(name: str, edges_of: Callable[[SparkSession, Grid], DataFrame]) -> None:
    """A lattice of one's own: edges_of gives its interior edges (u, v), u < v, each once; sides stay those of the grid."""
    CUSTOM.add(name.lower())
    REGISTRY[name.lower()] = edges_of


def nodes(spark: SparkSession, grid: Grid) -> DataFrame:
    """(node, x, y, t) of every valid node."""
    n = spark.range(grid.num_detectors).select(F.col("id"))
    x, y, t = F.col("id") % grid.width, F.floor(F.col("id") / grid.width) % grid.height, F.floor(F.col("id") / (grid.width * grid.height))
    return n.select(x.alias("x"), y.alias("y"), t.alias("t")).select(ids.node(grid, "x", "y", "t").alias("node"), "x", "y", "t")


def detector_layout(spark: SparkSession, d: int, rounds: int, code: str = "rotated", basis: str | None = None) -> DataFrame:
    """(det_id, x, y, t): detectors of a surface code, numbered densely round by round and row by row.

    rotated: (d-1) x (d-1) places, the even ones X and the odd ones Z; unrotated: d x (d-1) places for X (also
    where no basis is asked for), (d-1) x d for Z.
    """
    if code == "rotated":
        w, h = d - 1, d - 1
        keep = {"X": lambda s: s % 2 == 0, "Z": lambda s: s % 2 == 1, None: lambda s: F.lit(True)}[basis]
    else:
        w, h = (d - 1, d) if basis == "Z" else (d, d - 1)
        keep = lambda s: F.lit(True)
    n = nodes(spark, Grid(w, h, rounds, "grid3d" if rounds > 1 else "square")).filter(keep(F.col("x") + F.col("y")))
    return numbered(n, ["t", "y"], ["x"], "det_id").select("det_id", "x", "y", "t")


def word_neighbours(spark: SparkSession, three_d: bool = False) -> DataFrame:
    """(bit, neighbour) within one 64-node word: an 8 x 8 grid, or 4 x 4 x 4 in Morton order."""
    bit = spark.range(64).select(F.col("id").alias("bit"))
    both = bit.crossJoin(bit.select(F.col("bit").alias("neighbour")))  # 64 x 64 rows
    if three_d:
        a, b = ids.morton_3d_coord("bit"), ids.morton_3d_coord("neighbour")
    else:
        a, b = ((F.col(c) % 8, F.floor(F.col(c) / 8)) for c in ("bit", "neighbour"))
    apart = sum((F.abs(p - q) for p, q in list(zip(a, b, strict=True))[1:]), F.abs(a[0] - b[0]))
    return both.filter(apart == 1)


def neighbours(spark: SparkSession, grid: Grid) -> DataFrame:
    """(node, neighbour): the directed adjacency by the lattice's rule.

    square: left, right, up (y - 1), down; grid3d also t - 1 and t + 1; triangular: also up-right from nodes
    whose x and y have an even number of ones together and down-left from the others; honeycomb: left, right,
    and up from even nodes or down from odd ones.
    """
    even = F.pmod(F.bit_count(ids.lng("x")) + F.bit_count(ids.lng("y")), F.lit(2)) == 0
    true = F.lit(True)
    moves = {
        "square": [(-1, 0, 0, true), (1, 0, 0, true), (0, -1, 0, true), (0, 1, 0, true)],
        "triangular": [(-1, 0, 0, true), (1, 0, 0, true), (0, -1, 0, true), (0, 1, 0, true), (1, -1, 0, even), (-1, 1, 0, ~even)],
        "honeycomb": [(-1, 0, 0, true), (1, 0, 0, true), (0, -1, 0, even), (0, 1, 0, ~even)],
    }
    moves["grid3d"] = [*moves["square"], (0, 0, -1, true), (0, 0, 1, true)]
    steps = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("t") + dt).alias("t"), when.alias("on")) for dx, dy, dt, when in moves[grid.topology]])
    to = nodes(spark, grid).select("node", F.explode(steps).alias("s"))
    return to.filter(F.col("s.on") & ids.in_bounds(grid, "s.x", "s.y", "s.t")).select("node", ids.node(grid, "s.x", "s.y", "s.t").alias("neighbour"))


def edges(spark: SparkSession, grid: Grid) -> DataFrame:
    """(edge_id, u, v): interior edges, then one boundary edge (v null) for each enabled side of a node."""
    if grid.topology in REGISTRY:
        interior = REGISTRY[grid.topology](spark, grid)
    else:
        interior = neighbours(spark, grid).select(F.least("node", "neighbour").alias("u"), F.greatest("node", "neighbour").alias("v")).distinct()
    b = grid.boundary
    sides = [(on, k, c) for k, (on, c) in enumerate(((b.left, F.col("x") == 0), (b.right, F.col("x") == grid.width - 1), (b.top, F.col("y") == 0), (b.bottom, F.col("y") == grid.height - 1))) if on]
    rows = interior.select("u", "v", F.lit(-1).alias("side"))
    for _, k, c in sides:
        rows = rows.unionByName(nodes(spark, grid).filter(c).select(F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"), F.lit(k).alias("side")))
    rows = rows.withColumn("outer", F.col("v").isNull()).withColumn("line", F.shiftright("u", grid.stride_y.bit_length() - 1))
    return numbered(rows, ["outer", "line"], ["u", F.coalesce("v", F.lit(0)), "side"], "edge_id").select("edge_id", "u", "v")


def numbered(rows: DataFrame, blocks: list[str], order: list, name: str) -> DataFrame:
    """rows with a dense number from 0 in the order of blocks and, in a block, of `order`.

    Rows are numbered block by block; only the blocks' sizes, one row for each line of a lattice, are added up in one task.
    """
    sizes = rows.groupBy(*blocks).agg(F.count("*").alias("n"))
    before = sizes.select(*blocks, (F.sum("n").over(Window.orderBy(*blocks)) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*blocks).orderBy(*order)) - 1
    return rows.withColumn("inside", inside).join(before, blocks).withColumn(name, (F.col("before") + F.col("inside")).cast("bigint"))


#: Ids of one lattice alone: all.
_ALL = ((-(1 << 62), 1 << 62),)


def spans(parts: list[Grid]) -> list[tuple[int, int]]:
    """[low, high) of the ids that each of several lattices has side by side."""
    out, at = [], 0
    for g in parts:
        out.append((at, at + g.stride_z * g.depth))
        at = out[-1][1]
    return out


class _Tables:
    """What the kernel reads of an adjacency, made once."""

    def tables(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(edges at each node, one past the last edge where there is none; whether the node is an edge's first end)."""
        if getattr(self, "_tables", None) is None or self._tables[0].dtype != kind:
            none = self.at < 0
            slots = np.where(none, len(self.u), self.at)
            first = np.append(self.u, -1)[slots] == np.arange(len(self.public))[:, None]
            self._tables = slots.astype(kind), first
        return self._tables


class GraphAdjacency(_Tables):
    """As Adjacency for any edges (u, v; v = -1 at the boundary) in the order of their ids; nodes are those they name."""

    spans = _ALL

    def __init__(self, u: np.ndarray, v: np.ndarray):
        self.public = np.unique(np.concatenate([u, v[v >= 0]]))
        self.u = np.searchsorted(self.public, u)
        self.v = np.where(v >= 0, np.searchsorted(self.public, np.maximum(v, 0)), -1)
        Adjacency._index(self, np.ones(len(u), bool))

    def to_dense(self, public: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.public, public), max(len(self.public) - 1, 0))
        return np.where(self.public[k] == public, k, -1) if len(self.public) else np.full(len(public), -1)


class Adjacency(_Tables):
    """The edges of a lattice as arrays for the decoding kernel: nodes are numbered densely in (t, y, x) order."""

    spans = _ALL

    def __init__(self, grid: Grid, erased: frozenset[int] = frozenset()):
        self.grid = grid
        w, h, d = grid.width, grid.height, grid.depth
        idx = np.arange(w * h * d).reshape(d, h, w)
        t, y, x = np.unravel_index(np.arange(w * h * d), (d, h, w))
        self.public = t * grid.stride_z + y * grid.stride_y + x
        pairs = []
        pairs.append(np.stack([idx[:, :, :-1].ravel(), idx[:, :, 1:].ravel()], 1))
        vertical = np.stack([idx[:, :-1, :].ravel(), idx[:, 1:, :].ravel()], 1)
        if grid.topology in ("triangular", "honeycomb"):
            ones = np.bitwise_count(x.astype(np.uint64)) + np.bitwise_count(y.astype(np.uint64))
            even = ones % 2 == 0
            if grid.topology == "honeycomb":  # up from an even lower node, or down from an odd upper node
                vertical = vertical[even[vertical[:, 1]] | ~even[vertical[:, 0]]]
            else:
                lower, upper = idx[:, 1:, :-1].ravel(), idx[:, :-1, 1:].ravel()
                keep = even[lower] | ~even[upper]
                pairs.append(np.stack([upper[keep], lower[keep]], 1))
        pairs.append(vertical)
        pairs.append(np.stack([idx[:-1].ravel(), idx[1:].ravel()], 1))
        inner = np.concatenate(pairs)
        inner = np.unique(np.stack([inner.min(1), inner.max(1)], 1), axis=0)
        gone = np.zeros(len(self.public), bool)
        if erased:
            gone = np.isin(self.public, np.fromiter(erased, np.int64, len(erased)))
        b = grid.boundary
        at = np.concatenate([np.zeros(0, np.int64)] + [np.flatnonzero(c) for on, c in ((b.left, x == 0), (b.right, x == w - 1), (b.top, y == 0), (b.bottom, y == h - 1)) if on])
        at = np.sort(at, kind="stable")
        self.u = np.concatenate([inner[:, 0], at])
        self.v = np.concatenate([inner[:, 1], np.full(len(at), -1)])
        self._index(~gone[self.u] & ((self.v < 0) | ~gone[np.maximum(self.v, 0)]))

    def _index(self, usable: np.ndarray) -> None:
        ends = np.concatenate([self.u[usable], self.v[usable & (self.v >= 0)]])
        eids = np.concatenate([np.flatnonzero(usable), np.flatnonzero(usable & (self.v >= 0))])
        order = np.lexsort((eids, ends))
        ends, eids = ends[order], eids[order]
        degree = np.bincount(ends, minlength=len(self.public))
        #: edges at each node by edge id, -1 where there are fewer than the most
        self.at = np.full((len(self.public), max(1, degree.max(initial=0))), -1, np.int64)
        self.at[ends, np.arange(len(ends)) - np.repeat(np.cumsum(degree) - degree, degree)] = eids

    def to_dense(self, public: np.ndarray) -> np.ndarray:
        """Dense number of public ids, -1 for ids outside the lattice."""
        g = self.grid
        x, y, t = public % g.stride_y, public // g.stride_y % g.stride_y, public // g.stride_z
        ok = (public >= 0) & (x < g.width) & (y < g.height) & (t < g.depth)
        return np.where(ok, (t * g.height + y) * g.width + x, -1)


class UnionAdjacency(_Tables):
    """Several lattices side by side as one graph: each one's ids, nodes and edges follow those of the one before."""

    def __init__(self, parts: tuple[tuple[Grid, frozenset[int]], ...]):
        self.parts = [Adjacency(g, erased) for g, erased in parts]
        self.spans = spans([g for g, _ in parts])
        self.first = np.cumsum([0] + [len(a.public) for a in self.parts])
        edges = np.cumsum([0] + [len(a.u) for a in self.parts])
        self.public = np.concatenate([a.public + low for a, (low, _) in zip(self.parts, self.spans, strict=True)])
        self.u = np.concatenate([a.u + n for a, n in zip(self.parts, self.first, strict=False)])
        self.v = np.concatenate([np.where(a.v >= 0, a.v + n, -1) for a, n in zip(self.parts, self.first, strict=False)])
        width = max(a.at.shape[1] for a in self.parts)
        self.at = np.concatenate([np.pad(np.where(a.at >= 0, a.at + e, -1), ((0, 0), (0, width - a.at.shape[1])), constant_values=-1) for a, e in zip(self.parts, edges, strict=False)])

    def to_dense(self, public: np.ndarray) -> np.ndarray:
        out = np.full(len(public), -1, np.int64)
        for a, (low, high), n in zip(self.parts, self.spans, self.first, strict=False):
            mine = np.flatnonzero((public >= low) & (public < high))
            dense = a.to_dense(public[mine] - low)
            out[mine] = np.where(dense >= 0, dense + n, -1)
        return out
