"""Exact minimum-weight matching of sparse shots, a second decoder to compare cluster growth with.

On square and cubic lattices with equal weights, two defects lie as far apart as their coordinates and a defect as far
from the boundary as from its nearest open side. A shot's least total over all pairings, each defect with another
or with the boundary, comes from a table over subsets of its defects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.grids import Grid
from . import decode as decoding

#: Defects up to which a shot is matched; the table has two to the power of that many entries.
MOST = 12

SCHEMA = "shot_id bigint, n_defects int, weight int, predicted int, resolved boolean"


def _sides(grid: Grid, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges to the nearest open side, observable bit of that side) of nodes; a large number without open sides."""
    b, far = grid.boundary, np.full(len(x), 1 << 20)
    found = [np.where(on, d + 1, far) for on, d in ((b.left, x), (b.right, grid.width - 1 - x), (b.top, y), (b.bottom, grid.height - 1 - y))]
    nearest = np.argmin(found, axis=0)
    return np.min(found, axis=0), np.where(nearest < 2, 2, 1)


def match(grid: Grid, nodes: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """(weight, pairs) of a shot's defects (public ids); the second of a pair is -1 for the boundary.

    A weight of 2^20 or more says that some defect has no partner.
    """
    side = grid.stride_y
    x, y, t = nodes % side, nodes // side % side, nodes // grid.stride_z
    apart = (abs(x[:, None] - x) + abs(y[:, None] - y) + abs(t[:, None] - t)).tolist()
    out = _sides(grid, x, y)[0].tolist()
    n = len(nodes)
    best, choice = [0] + [1 << 30] * ((1 << n) - 1), [(-1, -1)] * (1 << n)
    for done in range(1 << n):
        low = next((k for k in range(n) if not done >> k & 1), None)
        if low is None or best[done] >= 1 << 30:
            continue
        for k in [-1, *(k for k in range(low + 1, n) if not done >> k & 1)]:
            new = done | 1 << low | (1 << k if k >= 0 else 0)
            total = best[done] + (apart[low][k] if k >= 0 else out[low])
            if total < best[new]:
                best[new], choice[new] = total, (low, k)
    pairs, at = [], (1 << n) - 1
    while at:
        a, b = choice[at]
        pairs.append((a, b))
        at &= ~(1 << a | (1 << b if b >= 0 else 0))
    return best[-1], pairs


def decode(defects: DataFrame, grid: Grid, most: int = MOST) -> DataFrame:
    """(shot_id, n_defects, weight, predicted, resolved) of the shots of at most `most` defects, as decoding.decode counts them.

    predicted: the XOR of the sides' observables that its boundary pairs end at.
    """
    if grid.topology not in ("square", "grid3d"):
        raise ValueError(f"distances on {grid.topology} lattices are not those of coordinates")

    def run(batches):
        for batch in batches:
            rows = []
            for shot, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes = np.array(own, np.int64)
                weight, pairs = match(grid, nodes)
                bits = _sides(grid, nodes % grid.stride_y, nodes // grid.stride_y % grid.stride_y)[1]
                flips = 0
                for a, b in pairs:
                    flips ^= int(bits[a]) if b < 0 else 0
                rows.append((shot, len(own), min(weight, 1 << 20), flips, weight < 1 << 20))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["shot_id", "n_defects", "weight", "predicted", "resolved"])

    shots = decoding.decode(defects, grid, carry=True, most=most).select("shot_id", "defects")
    return shots.mapInArrow(run, SCHEMA)
