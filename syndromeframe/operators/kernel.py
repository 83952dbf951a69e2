"""Union-Find decoding of many shots at once in numpy.

All shots of a chunk live in one disjoint graph: node k of shot s is k + s * nodes. Every cluster of odd parity
without a boundary grows its frontier by half an edge a round; full edges merge clusters, and a cluster's root
is its largest node. A spanning forest of the full edges, from the boundary edge with the least id or else from
the root, breadth first with the least edge id as parent, is then peeled: an edge is in the correction if the
part of the tree behind it holds an odd number of defects. Work follows the clusters, not the lattice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .lattice import Adjacency


@dataclass(frozen=True)
class Rules:
    """Exchangeable parts of the decoder.

    growth: what an active cluster adds to each of its edges in a round, "half" an edge or a "whole" one. start: where
    the tree of a cluster at the boundary starts, at its least "boundary" edge or at its "root", the largest node;
    a cluster of odd parity then leaves by that edge all the same.
    """

    growth: str = "half"
    start: str = "boundary"

    def __post_init__(self):
        if self.growth not in ("half", "whole") or self.start not in ("boundary", "root"):
            raise ValueError(f"unknown rules {self}")


RULES = Rules()


def _find(parent: np.ndarray, a: np.ndarray) -> np.ndarray:
    r = parent[a]
    while True:
        up = parent[r]
        if (up == r).all():
            break
        r = up
    parent[a] = r
    return r


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins pairs; the larger root wins."""
    while len(a):
        ra, rb = _find(parent, a), _find(parent, b)
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.maximum.at(parent, np.minimum(ra, rb), np.maximum(ra, rb))


def _once(a: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """a without repeats; scratch is any array that a indexes."""
    at = np.arange(len(a), dtype=scratch.dtype)
    scratch[a] = at
    return a[scratch[a] == at]


#: Support of an edge that is full, and of one that can't be used: a missing or an erased one.
FULL, GONE = 2, 3


def decode(adj: Adjacency, shot: np.ndarray, node: np.ndarray, shots: int, blocked: tuple[np.ndarray, np.ndarray] | None = None, rules: Rules = RULES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shot, edge) of the correction, sorted, and the (shot, node) defects that stay unresolved.

    shot, node: distinct defects, dense nodes; blocked: (shot, node) that are erased in that shot only. Edge e of shot s
    has slot s * (edges + 1) + e; the last slot of a shot stands for the places at a node without an edge.
    """
    n_nodes, width = len(adj.public), len(adj.u) + 1
    kind = np.int32 if shots * max(n_nodes, width) < 1 << 31 else np.int64
    parent = np.arange(shots * n_nodes, dtype=kind)
    support = np.zeros(shots * width, np.uint8)
    support[width - 1 :: width] = GONE
    slots, first = adj.tables(kind)
    u_of, v_of = adj.u.astype(kind), adj.v.astype(kind)
    if blocked is not None and len(blocked[0]):
        support[blocked[0][:, None] * width + slots[blocked[1]]] = GONE
    odd = np.zeros(shots * n_nodes, np.int8)
    defects = (shot * n_nodes + node).astype(kind)
    scratch = np.empty(shots * n_nodes, kind)
    cluster = [np.sort(defects)]
    inside, active, done = (np.zeros(shots * n_nodes, bool) for _ in range(3))
    inside[defects] = True
    # nodes of clusters that may have an edge to grow, with their place in a shot's lattice and their shot's first slot
    nodes, place = cluster[0], cluster[0] % n_nodes
    base = cluster[0] // n_nodes * kind(width)
    growing = np.arange(len(nodes))
    full: list[np.ndarray] = []
    touched: list[np.ndarray] = []
    while len(growing):
        at = place[growing]
        keys = slots[at] + base[growing, None]
        can = support[keys] < FULL
        some = can.any(1)
        if not some.all():  # these nodes are inside their clusters now
            keep = np.ones(len(nodes), bool)
            keep[growing[~some]] = False
            nodes, place, base = nodes[keep], place[keep], base[keep]
            at, keys, can = at[some], keys[some], can[some]
        if not len(at):
            break
        # an edge has one first and one second end, so each list names it once
        ahead = first[at]
        one, two = keys[can & ahead], keys[can & ~ahead]
        if rules.growth == "half":
            support[one] += 1
            filled = one[support[one] == FULL]
            two = two[support[two] < FULL]
            support[two] += 1
            new = np.concatenate([filled, two[support[two] == FULL]])
        else:
            support[one] = FULL
            two = two[support[two] < FULL]
            support[two] = FULL
            new = np.concatenate([one, two])
        full.append(new)
        s, e = np.divmod(new, kind(width))
        low = s * kind(n_nodes)
        u, v = low + u_of[e], v_of[e]
        inner = v >= 0
        outer, u, v = u[~inner], u[inner], low[inner] + v[inner]
        _union(parent, u, v)
        ends = np.concatenate([u, v])
        fresh = _once(ends[~inside[ends]], scratch)
        inside[fresh] = True
        cluster.append(fresh)
        # clusters that still have odd parity and no boundary
        roots = _find(parent, defects)
        odd[roots] = 0
        np.add.at(odd, roots, 1)
        active[roots] = odd[roots] % 2 == 1
        touched.append(outer)
        reached = np.concatenate(touched)
        reached = _find(parent, reached)
        active[reached] = False
        done[reached] = True
        touched = [reached]
        # a cluster at the boundary never grows again, an even one may once an odd one meets it
        nodes, place = np.concatenate([nodes, fresh]), np.concatenate([place, fresh % kind(n_nodes)])
        base = np.concatenate([base, fresh // kind(n_nodes) * kind(width)])
        roots = _find(parent, nodes)
        keep = ~done[roots]
        nodes, place, base, roots = nodes[keep], place[keep], base[keep], roots[keep]
        growing = np.flatnonzero(active[roots])
    return _peel(adj, np.concatenate(full) if full else np.zeros(0, kind), support, parent, np.concatenate(cluster), defects, rules)


def _peel(adj: Adjacency, full: np.ndarray, support: np.ndarray, parent: np.ndarray, cluster: np.ndarray, defects: np.ndarray, rules: Rules = RULES):
    """decode's result from the full edges (those with support FULL) and the clusters' roots."""
    n_nodes, width, kind = len(adj.public), len(adj.u) + 1, parent.dtype.type
    slots, first = adj.tables(kind)
    u_of, v_of = adj.u.astype(kind), adj.v.astype(kind)
    roots = _find(parent, cluster)
    s, e = np.divmod(full, kind(width))
    outer = v_of[e] < 0
    on = np.sort(full[outer])
    s, e = np.divmod(on, kind(width))
    at = s * kind(n_nodes) + u_of[e]
    own = _find(parent, at) if len(at) else at
    # the least boundary edge of each cluster, which is sorted by shot and edge already
    exit_root, index = np.unique(own, return_index=True)
    exit_node, exit_edge = at[index], on[index]
    out_node = out_edge = np.zeros(0, kind)
    if rules.start == "root" and len(exit_root):  # odd clusters leave by their exit, whose parity changes for it
        own, n = np.unique(_find(parent, defects), return_counts=True)
        leave = np.isin(exit_root, own[n % 2 == 1])
        out_node, out_edge = exit_node[leave], exit_edge[leave]
        exit_root = exit_node = exit_edge = np.zeros(0, kind)
    inner_root = np.setdiff1d(np.unique(roots), exit_root)
    start = np.concatenate([exit_node, inner_root])
    up_edge, up_node = np.empty(len(parent), kind), np.empty(len(parent), kind)  # set where a node is reached
    seen = np.zeros(len(parent), bool)
    seen[start] = True
    # what a tree has to reach: its defects and, where one leaves, the exit; it ends with the last of them
    wanted = np.zeros(len(parent), bool)
    wanted[defects] = True
    wanted[out_node] = True
    missing = np.zeros(len(parent), np.int32)
    goals = np.unique(np.concatenate([defects, out_node]))
    goals = goals[~seen[goals]]
    np.add.at(missing, parent[goals], 1)
    scratch = np.empty(len(parent), kind)
    front, levels = start[missing[_find(parent, start)] > 0], []
    while len(front):
        s, k = np.divmod(front, kind(n_nodes))
        key = slots[k] + (s * kind(width))[:, None]
        r, c = np.nonzero(support[key] == FULL)
        key, ahead, k = key[r, c], first[k[r], c], k[r]
        e = key - s[r] * kind(width)
        other = np.where(ahead, v_of[e], u_of[e])
        inner = other >= 0
        other = s[r] * kind(n_nodes) + other
        new = inner & ~seen[other]
        other, key, came = other[new], key[new], front[r[new]]
        order = np.argsort(key, kind="stable")[::-1]  # of several ways to a node the least edge is written last
        other, key, came = other[order], key[order], came[order]
        up_edge[other], up_node[other] = key, came
        front = _once(other, scratch)
        seen[front] = True
        levels.append(front)
        got = front[wanted[front]]
        np.subtract.at(missing, parent[got], 1)
        front = front[missing[parent[front]] > 0]
    odd = np.zeros(len(parent), bool)
    odd[defects] = True
    odd[out_node] ^= True
    chosen = [out_edge]
    for level in reversed(levels):
        hot = level[odd[level]]
        if len(hot):
            chosen.append(up_edge[hot])
            odd[hot] = False
            flip, n = np.unique(up_node[hot], return_counts=True)
            odd[flip[n % 2 == 1]] ^= True
    through = odd[exit_node]
    chosen.append(exit_edge[through])
    odd[exit_node[through]] = False
    left = inner_root[odd[inner_root]]
    picked = np.sort(np.concatenate(chosen)).astype(np.int64)
    shot, edge = np.divmod(picked, width)
    left_shot, left_node = np.divmod(left.astype(np.int64), n_nodes)
    return shot, edge, left_shot, left_node
