"""Packed syndromes: words of 64 node bits in signed bigints (bit 63 is the sign)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import lng


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def pack(defects: DataFrame, key: str = "shot_id", node: str = "node") -> DataFrame:
    """(key, word_idx, word): the bits of all nodes of a shot, word by word.

    Rows that are dealt by key already, as parity leaves them, stay where they are.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(node), F.lit(64)).cast("int"))
    return defects.groupBy(key, F.floor(F.col(node) / 64).cast("bigint").alias("word_idx")).agg(F.bit_or(bit).alias("word"))


def unpack(packed: DataFrame, key: str = "shot_id") -> DataFrame:
    """(key, node) of every set bit; only words with a bit make rows."""
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("word", b) == 1)
    bits = packed.filter("word <> 0").select(key, "word_idx", F.explode(on).alias("bit"))
    return bits.select(key, (F.col("word_idx") * 64 + F.col("bit")).cast("bigint").alias("node"))


def popcounts(packed: DataFrame, key: str = "shot_id") -> DataFrame:
    return packed.groupBy(key).agg(F.sum(F.bit_count("word")).cast("bigint").alias("n_defects"))


def _shift(w: Column, by: int) -> Column:
    return F.shiftleft(w, by) if by > 0 else F.shiftrightunsigned(w, -by)


def _settle(first: Column, rounds: int, step) -> Column:
    """step applied `rounds` times; further rounds of a settled word change nothing."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda acc, _: step(acc))


def spread_8x8(word, mask) -> Column:
    """Eight dilations to the four neighbours in an 8 x 8 word, kept within mask."""
    not_first, not_last = signed(0xFEFEFEFEFEFEFEFE), signed(0x7F7F7F7F7F7F7F7F)
    mask = lng(mask)

    def step(w):
        east, west = _shift(w, 1).bitwiseAND(not_first), _shift(w, -1).bitwiseAND(not_last)
        return w.bitwiseOR(east).bitwiseOR(west).bitwiseOR(_shift(w, 8)).bitwiseOR(_shift(w, -8)).bitwiseAND(mask)

    return _settle(lng(word), 8, step)


def _doubling(word: Column, mask: Column, barrier) -> Column:
    """Shifts by 1, 2, 4 to 32 both ways within mask; stops at the first that changes nothing."""
    state = F.struct(word.alias("w"), F.lit(False).alias("done"))

    def step(acc, by):
        w = acc["w"]
        left, right = barrier(w, by)
        new = w.bitwiseOR(left).bitwiseOR(right).bitwiseAND(mask)
        return F.struct(F.when(acc["done"], w).otherwise(new).alias("w"), (acc["done"] | (new == w)).alias("done"))

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(6)]), state, step)["w"]


def spread_linear(word, mask) -> Column:
    return _doubling(lng(word), lng(mask), lambda w, by: (F.call_function("shiftleft", w, by), F.call_function("shiftrightunsigned", w, by)))


def _row_masks(stride: int) -> tuple[list[int], list[int]]:
    """For each shift 1, 2, .. 32, the bits that a left shift (right shift) by it would carry out of their row."""
    left, right = [], []
    for k in range(6):
        by = 1 << k
        left.append(signed(sum(1 << b for b in range(64) if b % stride >= stride - by)))
        right.append(signed(sum(1 << b for b in range(64) if b % stride < by)))
    return left, right


def spread_masked(word, mask, stride: int) -> Column:
    """As spread_linear without leaving a row of `stride` bits."""
    left, right = _row_masks(stride)
    at = F.array(*[F.struct(F.lit(1 << k).alias("by"), F.lit(~left[k]).alias("l"), F.lit(~right[k]).alias("r")) for k in range(6)])
    mask = lng(mask)
    state = F.struct(lng(word).alias("w"), F.lit(False).alias("done"))

    def step(acc, s):
        w = acc["w"]
        new = w.bitwiseOR(F.call_function("shiftleft", w.bitwiseAND(s["l"]), s["by"])).bitwiseOR(F.call_function("shiftrightunsigned", w.bitwiseAND(s["r"]), s["by"])).bitwiseAND(mask)
        return F.struct(F.when(acc["done"], w).otherwise(new).alias("w"), (acc["done"] | (new == w)).alias("done"))

    return F.aggregate(at, state, step)["w"]


def _axis_masks() -> list[tuple[int, int]]:
    """(shift, mask of source bits) of a step to each neighbour in a 4 x 4 x 4 word in Morton order."""
    found = []
    for axis in range(3):
        low, high = 1 << axis, 8 << axis
        for shift, take in ((low, lambda b, lo=low: not b & lo), (high - low, lambda b, lo=low, hi=high: b & lo and not b & hi)):
            found.append((shift, signed(sum(1 << b for b in range(64) if take(b)))))
        for shift, take in ((-low, lambda b, lo=low: b & lo), (low - high, lambda b, lo=low, hi=high: not b & lo and b & hi)):
            found.append((shift, signed(sum(1 << b for b in range(64) if take(b)))))
    return found


def spread_3d(word, mask) -> Column:
    """Nine dilations to the six neighbours in a 4 x 4 x 4 word in Morton order."""
    steps, mask = _axis_masks(), lng(mask)

    def step(w):
        new = w
        for shift, source in steps:
            new = new.bitwiseOR(_shift(w.bitwiseAND(source), shift))
        return new.bitwiseAND(mask)

    return _settle(lng(word), 9, step)


def face_mask_3d(axis: int, end: bool) -> int:
    """Bits of one face of a 4 x 4 x 4 word in Morton order (16 bits)."""
    both = (1 << axis) | (8 << axis)
    return signed(sum(1 << b for b in range(64) if (b & both) == (both if end else 0)))
