"""One-syndrome interfaces: packed words in, flat edge lists out, on the same kernel as the DataFrame operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import kernel
from .operators.decode import decode_packed
from .operators.lattice import Adjacency
from .plans.grids import Boundary, Grid, required_buffer_size, topology_name

__all__ = ["BOUNDARY", "Decoder", "DecoderBuilder", "QecEngine", "TopologyType", "required_buffer_size"]

#: What stands for the boundary in flat edge lists.
BOUNDARY = 0xFFFFFFFF


class TopologyType:
    """A topology by name, in any case; ValueError for an unknown one."""

    def __init__(self, name: str = "square"):
        self.name = topology_name(name)

    def __repr__(self) -> str:
        return f"TopologyType({self.name!r})"

    def __str__(self) -> str:
        return self.name

    def __eq__(self, other: object) -> bool:
        return isinstance(other, TopologyType) and other.name == self.name

    def __hash__(self) -> int:
        return hash(self.name)


for _name, _topology in {"Square": "square", "Triangular": "triangular", "Honeycomb": "honeycomb", "Grid3D": "grid3d"}.items():
    setattr(TopologyType, _name, TopologyType(_topology))


def unpack_words(words: np.ndarray) -> np.ndarray:
    """Nodes of the set bits of uint64 words."""
    bits = np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8), bitorder="little")
    return np.flatnonzero(bits)


class Decoder:
    """Decodes one packed syndrome at a time: bit y * stride + x (+ t * stride^2) of uint64 words.

    Bits outside the lattice are dropped, missing words are empty. Nothing is kept between calls but erasures.
    """

    def __init__(self, width: int, height: int, topology: str | TopologyType = "square", depth: int = 1, boundary: Boundary = Boundary(), stride: int | None = None):
        for name, n in (("width", width), ("height", height), ("depth", depth)):
            if n < 1:
                raise ValueError(f"{name} must be greater than 0")
        kind = str(topology) if isinstance(topology, TopologyType) else topology_name(topology)
        self.grid = Grid(width, height, depth, kind, boundary, stride)
        self._adjacency = Adjacency(self.grid)
        self._erased = frozenset()

    def load_erasures(self, words: np.ndarray) -> None:
        """Nodes that no correction may use, until the next call; fewer words than nodes mean no erasure there."""
        self._erased = frozenset(unpack_words(words).tolist())
        self._adjacency = Adjacency(self.grid, self._erased)

    def decode(self, syndrome: np.ndarray) -> np.ndarray:
        """uint32 array u0, v0, u1, v1, .. of the correction, BOUNDARY for the boundary."""
        adj = self._adjacency
        nodes = adj.to_dense(unpack_words(syndrome))
        nodes = nodes[nodes >= 0]
        _, edge, _, _ = kernel.decode(adj, np.zeros(len(nodes), np.int64), nodes, 1)
        v = adj.v[edge]
        pairs = np.stack([adj.public[adj.u[edge]], np.where(v < 0, BOUNDARY, adj.public[np.maximum(v, 0)])], 1)
        return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].astype(np.uint32).ravel()

    def reset(self) -> None:
        """Forgets erasures."""
        self.load_erasures(np.zeros(0, np.uint64))

    def decode_frame(self, packed: DataFrame) -> DataFrame:
        """decode for each shot of (shot_id, word_idx, word): the DataFrame form."""
        return decode_packed(packed, self.grid, self._erased)


class DecoderBuilder:
    """Collects dimensions and builds a Decoder.

    ValueError without dimensions, or with a stride that is no power of two or less than the largest dimension.
    """

    def __init__(self, topology: str = "square"):
        self._topology, self._shape, self._stride = topology, None, None

    def dimensions(self, width: int, height: int) -> DecoderBuilder:
        self._shape = (width, height, 1)
        return self

    def dimensions_3d(self, width: int, height: int, depth: int) -> DecoderBuilder:
        self._shape = (width, height, depth)
        return self

    def stride_y(self, stride: int) -> DecoderBuilder:
        self._stride = stride
        return self

    def build(self) -> Decoder:
        if self._shape is None:
            raise ValueError("dimensions must be set")
        width, height, depth = self._shape
        return Decoder(width, height, self._topology, depth, stride=self._stride)


class QecEngine:
    """Cycles of dense syndromes: each call decodes one and returns its correction as (u, v) pairs, v None at the boundary."""

    def __init__(self, width: int, height: int, topology: str = "square", depth: int = 1):
        self.decoder = Decoder(width, height, topology, depth)

    def load_erasures(self, words: np.ndarray) -> None:
        self.decoder.load_erasures(words)

    def process_cycle_dense(self, syndrome: np.ndarray) -> list[tuple[int, int | None]]:
        flat = self.decoder.decode(syndrome).reshape(-1, 2).tolist()
        return [(u, None if v == BOUNDARY else v) for u, v in flat]


def dense_booleans(packed: np.ndarray, grid: Grid) -> np.ndarray:
    """A packed syndrome as booleans in row-major order without padding."""
    out = np.zeros(grid.num_detectors, bool)
    nodes = Adjacency(grid).to_dense(unpack_words(packed))
    out[nodes[nodes >= 0]] = True
    return out


def pack_booleans(dense: np.ndarray, grid: Grid) -> np.ndarray:
    """The inverse of dense_booleans."""
    out = np.zeros(grid.words * 64, np.uint8)
    out[Adjacency(grid).public[np.flatnonzero(dense)]] = 1
    return np.packbits(out, bitorder="little").view("<u8")


def vertices(defects: DataFrame, grid: Grid) -> DataFrame:
    """(shot_id, vertices): sorted row-major ids of each shot's defects, the sparse form other solvers take."""
    from .functions import ids

    x, y, t = ids.coord(grid, "node")
    return defects.select("shot_id", ids.dense_id(grid, x, y, t).alias("k")).groupBy("shot_id").agg(F.array_sort(F.collect_list("k")).alias("vertices"))


