"""Node, Morton and tile ids, boundary and colour rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.grids import Grid

MASK_X, MASK_Y = 0x55555555, 0xAAAAAAAA


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def lng(x) -> Column:
    return col(x).cast("bigint")


# --- row-major ids over power-of-two strides ----------------------------------------------------------------------


def node(grid: Grid, x, y, t=0) -> Column:
    return lng(t) * grid.stride_z + lng(y) * grid.stride_y + lng(x)


def coord(grid: Grid, n) -> tuple[Column, Column, Column]:
    """(x, y, t) of a node id by shifts and masks."""
    bits = grid.stride_y.bit_length() - 1
    n = lng(n)
    return n.bitwiseAND(grid.stride_y - 1), F.shiftright(n, bits).bitwiseAND(grid.stride_y - 1), F.shiftright(n, 2 * bits)


def in_bounds(grid: Grid, x, y, t=0) -> Column:
    x, y, t = col(x), col(y), col(t)
    return (x >= 0) & (x < grid.width) & (y >= 0) & (y < grid.height) & (t >= 0) & (t < grid.depth)


def dense_id(grid: Grid, x, y, t=0) -> Column:
    """Row-major id without padding."""
    return (lng(t) * grid.height + lng(y)) * grid.width + lng(x)


def is_boundary(grid: Grid, x, y) -> Column:
    """Whether a node lies on a side that carries boundary edges."""
    b, x, y = grid.boundary, col(x), col(y)
    found = F.lit(False)
    for on, side in ((b.left, x == 0), (b.right, x == grid.width - 1), (b.top, y == 0), (b.bottom, y == grid.height - 1)):
        found = found | side if on else found
    return found


# --- Morton ids ---------------------------------------------------------------------------------------------------


def _ladder(x: Column, steps) -> Column:
    for shift, mask in steps:
        x = x.bitwiseOR(F.shiftleft(x, shift) if shift > 0 else F.shiftright(x, -shift)).bitwiseAND(mask)
    return x


# Fixed values: (shift, mask) steps that spread or compact the bits of a coordinate.
_SPREAD_2D = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))
_COMPACT_2D = ((-1, 0x33333333), (-2, 0x0F0F0F0F), (-4, 0x00FF00FF), (-8, 0x0000FFFF))
_SPREAD_3D = ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))
_COMPACT_3D = ((-2, 0x030C30C3), (-4, 0x0300F00F), (-8, 0x030000FF), (-16, 0x000003FF))


def spread_2d(x) -> Column:
    return _ladder(lng(x).bitwiseAND(0xFFFF), _SPREAD_2D)


def compact_2d(m) -> Column:
    return _ladder(lng(m).bitwiseAND(MASK_X), _COMPACT_2D)


def spread_3d(x) -> Column:
    return _ladder(lng(x).bitwiseAND(0x3FF), _SPREAD_3D)


def compact_3d(m) -> Column:
    return _ladder(lng(m).bitwiseAND(0x09249249), _COMPACT_3D)


def morton_2d(x, y) -> Column:
    """x at the even bits, y at the odd ones."""
    return spread_2d(x).bitwiseOR(F.shiftleft(spread_2d(y), 1))


def morton_2d_coord(m) -> tuple[Column, Column]:
    return compact_2d(m), compact_2d(F.shiftright(lng(m), 1))


def morton_3d(x, y, z) -> Column:
    return spread_3d(x).bitwiseOR(F.shiftleft(spread_3d(y), 1)).bitwiseOR(F.shiftleft(spread_3d(z), 2))


def morton_3d_coord(m) -> tuple[Column, Column, Column]:
    return compact_3d(m), compact_3d(F.shiftright(lng(m), 1)), compact_3d(F.shiftright(lng(m), 2))


def _step(m: Column, mask: int, by: int) -> Column:
    rest = 0xFFFFFFFF ^ mask
    moved = (m.bitwiseOR(rest) + 1) if by > 0 else (m.bitwiseAND(mask) - 1)
    return moved.bitwiseAND(mask).bitwiseOR(m.bitwiseAND(rest))


def morton_inc(m, mask: int) -> Column:
    """One step up along the axis of mask, wrapping within 32 bits."""
    return _step(lng(m), mask, 1)


def morton_dec(m, mask: int) -> Column:
    return _step(lng(m), mask, -1)


# --- bits ---------------------------------------------------------------------------------------------------------


def trailing_zeros(w) -> Column:
    """Number of zeros below the lowest one; 64 for zero."""
    w = lng(w)
    return F.when(w == 0, 64).otherwise(F.bit_count(w.bitwiseAND(-w) - 1)).cast("bigint")


def clear_lowest(w) -> Column:
    w = lng(w)
    return w.bitwiseAND(w - 1)


def next_pow2(n) -> Column:
    """Least power of two that is n or more, exactly for n up to 2^62."""
    n = lng(n) - 1
    for shift in (1, 2, 4, 8, 16, 32):
        n = n.bitwiseOR(F.shiftright(n, shift))
    return F.when(n < 0, 1).otherwise(n + 1).cast("bigint")


# --- tiles of 32 x 32 ---------------------------------------------------------------------------------------------


def tile_node(x, y, tiles_x: int) -> Column:
    x, y = lng(x), lng(y)
    tile = F.shiftright(y, 5) * tiles_x + F.shiftright(x, 5)
    return F.shiftleft(tile, 10) + F.shiftleft(y.bitwiseAND(31), 5) + x.bitwiseAND(31)


def tile_coord(n, tiles_x: int) -> tuple[Column, Column]:
    n = lng(n)
    tile = F.shiftright(n, 10)
    return (tile % tiles_x) * 32 + n.bitwiseAND(31), F.floor(tile / tiles_x) * 32 + F.shiftright(n, 5).bitwiseAND(31)


# --- detectors, colours, observables ------------------------------------------------------------------------------


def int_coord(x) -> Column:
    """Coordinate rounded half up, negative ones to zero."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor(col(x) + 0.5))


def color(x, y) -> Column:
    return F.pmod(lng(x) + lng(y), F.lit(3))


def next_color(c) -> Column:
    """Red, green, blue and red again."""
    return F.pmod(lng(c) + 1, F.lit(3))


def previous_color(c) -> Column:
    return F.pmod(lng(c) + 2, F.lit(3))


def observable_mask(k) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), col(k).cast("int"))


def side_observable(grid: Grid, x, y) -> Column:
    """Both bits by side: 2 on the left or right, 1 on the top or bottom, 3 in a corner."""
    x, y = lng(x), lng(y)
    return F.when(x.isin(0, grid.width - 1), 2).otherwise(0).bitwiseOR(F.when(y.isin(0, grid.height - 1), 1).otherwise(0)).cast("bigint")


def boundary_observable(grid: Grid, x, y) -> Column:
    """One bit of a boundary correction: left or right wins over top or bottom, inside the nearer pair of sides."""
    x, y = lng(x), lng(y)
    to_x, to_y = F.least(x, grid.width - 1 - x), F.least(y, grid.height - 1 - y)
    return F.when(to_x == 0, 2).when(to_y == 0, 1).when(to_x <= to_y, 2).otherwise(1).cast("bigint")


def color_observable(c, is_boundary, side) -> Column:
    """1 for red, 2 for green at side 0 of a boundary; else 0."""
    return F.when(col(is_boundary) & (col(side) == 0), F.when(col(c) == 0, 1).when(col(c) == 1, 2).otherwise(0)).otherwise(0).cast("bigint")


def x_compact(x, y) -> tuple[Column, Column]:
    """Compact column and row of an even node."""
    return F.shiftright(lng(x) - lng(y) % 2, 1), lng(y)


def z_compact(x, y) -> tuple[Column, Column]:
    """Compact column and row of an odd node, with x and y exchanged."""
    return F.shiftright(lng(y), 1), lng(x)


def matching_weight(p) -> Column:
    """-1000 times the binary exponent of the odds; the ends of the 32-bit range for p <= 0 and p >= 1."""
    p = col(p).cast("double")
    return F.when(p <= 0, 2147483647).when(p >= 1, -2147483648).otherwise(-1000 * F.floor(F.log2((p / (1 - p)).cast("float").cast("double")))).cast("bigint")


def llr_weight(p) -> Column:
    """ln((1 - p) / p) with p kept within 1e-10 of the ends, and as an even integer."""
    p = F.least(F.greatest(col(p).cast("double"), F.lit(1e-10)), F.lit(1 - 1e-10))
    return F.ln((1 - p) / p)


def even_weight(w) -> Column:
    return (col(w) * 500).cast("bigint") * 2


def short_number(n, most: str = "G") -> Column:
    """1234 as 1.2K, and so on for M and G; no unit beyond `most`, so with K 1234567 is 1234.6K."""
    n = lng(n)
    found = n.cast("string")
    for power, unit in ((3, "K"), (6, "M"), (9, "G"))[: "KMG".index(most) + 1]:
        found = F.when(n >= 10**power, F.format_string(f"%.1f{unit}", n / float(10**power))).otherwise(found)
    return found


def grouped_number(n) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(lng(n), 0)
