"""Lattice specifications: dimensions, strides, boundary presets, named sizes and memory arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

TOPOLOGIES = ("square", "triangular", "honeycomb", "grid3d")
_ALIASES = {"3d": "grid3d"}
#: Names of lattices that users have registered (operators.lattice.register).
CUSTOM: set[str] = set()


@dataclass(frozen=True)
class Boundary:
    """Sides of the lattice that carry boundary edges: top is y = 0, bottom the last row, left is x = 0."""

    top: bool = True
    bottom: bool = True
    left: bool = True
    right: bool = True


BOUNDARIES = {
    "all": Boundary(),
    "none": Boundary(False, False, False, False),
    "horizontal_only": Boundary(True, True, False, False),
    "vertical_only": Boundary(False, False, True, True),
}


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def topology_name(name: str) -> str:
    """Canonical name of a topology, in any case; ValueError for an unknown one."""
    low = _ALIASES.get(name.lower(), name.lower())
    if low not in TOPOLOGIES and low not in CUSTOM:
        raise ValueError(f"unknown topology {name!r}")
    return low


@dataclass(frozen=True)
class Grid:
    """A lattice of width x height x depth nodes with row-major ids over power-of-two strides.

    stride: that of a row, the least one that holds the largest dimension unless a larger one is asked for.
    """

    width: int
    height: int
    depth: int = 1
    topology: str = "square"
    boundary: Boundary = Boundary()
    stride: int | None = None

    def __post_init__(self):
        if min(self.width, self.height, self.depth) < 1:
            raise ValueError("grid dimensions must be positive")
        object.__setattr__(self, "topology", topology_name(self.topology))
        if self.depth > 1 and self.topology in ("triangular", "honeycomb"):
            raise ValueError(f"{self.topology} lattices have depth 1")
        least = next_power_of_two(max(self.width, self.height, self.depth))
        if self.stride is not None and (self.stride < least or self.stride & (self.stride - 1)):
            raise ValueError(f"stride must be a power of two, {least} or more")

    @property
    def stride_y(self) -> int:
        return self.stride or next_power_of_two(max(self.width, self.height, self.depth))

    @property
    def stride_z(self) -> int:
        return self.stride_y**2

    @property
    def num_detectors(self) -> int:
        return self.width * self.height * self.depth

    @property
    def detectors_per_round(self) -> int:
        return self.width * self.height

    @property
    def alloc_nodes(self) -> int:
        """Ids of the padded lattice and the boundary node."""
        return self.stride_y ** (3 if self.depth > 1 else 2) + 1

    @property
    def words(self) -> int:
        return -(-self.alloc_nodes // 64)

    def node(self, x: int, y: int, t: int = 0) -> int:
        return t * self.stride_z + y * self.stride_y + x

    def coord(self, node: int) -> tuple[int, int, int]:
        return node % self.stride_y, node // self.stride_y % self.stride_y, node // self.stride_z

    def with_boundary(self, preset: str) -> Grid:
        return replace(self, boundary=BOUNDARIES[preset])

    def with_depth(self, depth: int) -> Grid:
        return replace(self, depth=depth, topology="grid3d" if depth > 1 else self.topology)


def rotated_surface(d: int, depth: int | None = None) -> Grid:
    return Grid(d - 1, d - 1, depth or d, "grid3d")


def unrotated_planar(d: int, depth: int | None = None) -> Grid:
    return Grid(d, d - 1, depth or d, "grid3d")


def x_stabilizers(d: int, depth: int | None = None) -> Grid:
    """Compact grid of one basis; a column that an odd width leaves over is kept."""
    return Grid(-(-(d - 1) // 2), d - 1, depth or d, "grid3d", BOUNDARIES["horizontal_only"])


def color_code(d: int, depth: int | None = None) -> Grid:
    return Grid(d, d, depth or d, "grid3d")


def restricted(grid: Grid) -> Grid:
    """Compact grid of one colour."""
    return replace(grid, width=-(-grid.width // 3), boundary=BOUNDARIES["horizontal_only"])


# Named sizes of square grids, distances and error rates of studies.
SQUARE_SIZES = (17, 22, 32, 64, 71, 316, 362)
DISTANCES = (3, 5, 7, 9, 11, 13)
ERROR_RATES = (0.001, 0.003, 0.006, 0.01, 0.03, 0.06)


def from_target_nodes(target: int) -> Grid:
    """The square grid of the least side whose area reaches target."""
    side = math.isqrt(target)
    return Grid(side + (side * side < target), side + (side * side < target))


def to_rectangular(grid: Grid, ratio: int = 2) -> Grid:
    return replace(grid, width=grid.width * ratio, height=max(1, grid.height // ratio))


def catalog(spark: SparkSession) -> DataFrame:
    """grids(grid_id, topology, width, height, depth, stride_y, stride_z, top, bottom, left, right) of the named sizes."""
    named = {f"square_{n}": Grid(n, n) for n in SQUARE_SIZES}
    for d in DISTANCES:
        named |= {f"rotated_{d}": rotated_surface(d), f"unrotated_{d}": unrotated_planar(d), f"color_{d}": color_code(d)}
    rows = [(k, g.topology, g.width, g.height, g.depth, g.stride_y, g.stride_z, g.boundary.top, g.boundary.bottom, g.boundary.left, g.boundary.right) for k, g in named.items()]
    return spark.createDataFrame(rows, "grid_id string, topology string, width int, height int, depth int, stride_y bigint, stride_z bigint, top boolean, bottom boolean, left boolean, right boolean")


#: Bytes that each array of a decoder may lose to alignment.
_PAD = 64


def required_buffer_size(width: int, height: int, depth: int = 1) -> int:
    """Bytes that a flat-memory decoder of these dimensions needs; ValueError for a zero dimension.

    Sizes in bytes: a header of 128; per node a parent of 4 and two search entries of 2; per block of 64 nodes a
    record of 64, three masks of 8 and lists of 4 and 32; per word of the four edge bits a node has 8 and 32;
    and one bit, in words of 8, for each block (four times) and for each edge word.
    """
    if min(width, height, depth) < 1:
        raise ValueError("dimensions must be positive")
    side = next_power_of_two(max(width, height, depth if depth > 1 else 1))
    nodes = side ** (3 if depth > 1 else 2) + 1
    blocks = -(-nodes // 64)
    edge_words = -(-nodes * 4 // 64)
    flags = -(-blocks // 64) * 8
    # Bytes of each array by node, block and edge word, which callers allocate to the byte.
    arrays = [128, *(nodes * k for k in (4, 2, 2)), *(blocks * k for k in (64, 8, 8, 8, 4, 32)), edge_words * 8, edge_words * 32, *[flags] * 4, -(-edge_words // 64) * 8]
    return sum(arrays) + _PAD * len(arrays)


def streaming_buffer_size(width: int, height: int, window: int) -> int:
    """As required_buffer_size for a sliding window: 16 bytes a round, 4 and 16 a detector of one layer."""
    layer = width * height
    return required_buffer_size(width, height, window) + sum(n + _PAD for n in (16 * window, 4 * layer, 16 * layer))


@dataclass(frozen=True)
class Window:
    """A sliding window of rounds over one layer of detectors; round r lies in ring layer r mod size."""

    size: int
    width: int
    height: int

    @property
    def grid(self) -> Grid:
        return Grid(self.width, self.height, self.size, "grid3d" if self.size > 1 else "square")

    @property
    def stride_y(self) -> int:
        return next_power_of_two(max(self.width, self.height, self.size))

    @property
    def blocks_per_round(self) -> int:
        return -(-self.width * self.height // 64)

    @property
    def total_blocks(self) -> int:
        return -(-self.stride_y**2 * self.size // 64)

    @property
    def alloc_nodes(self) -> int:
        return self.stride_y**2 * self.size + 1

    def node(self, x: int, y: int, round_: int) -> int:
        return round_ % self.size * self.stride_y**2 + y * self.stride_y + x


def rotated_window(d: int, size: int) -> Window:
    return Window(size, max(d - 1, 1), max(d - 1, 1))


#: Defects that a colour's buffer holds.
MAX_DEFECTS_PER_COLOR = 4096


def color_buffer_size(grid: Grid) -> int:
    """Bytes of three colours' defect buffers and one 4-byte entry a node."""
    return 3 * (MAX_DEFECTS_PER_COLOR * 4 + _PAD) + grid.alloc_nodes * 4
