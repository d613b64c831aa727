"""A space-filling curve (Morton order) as a key for files of tiles, and ranges of it that cover a window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each coordinate; a key has twice as many.
BITS = 31
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def morton(y: Column, x: Column) -> Column:
    """The bits of two whole numbers from 0 to 2**31 - 1 in turns, those of y first."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(y), 1).bitwiseOR(spread(x))


def cover(y0: int, y1: int, x0: int, x1: int, most: int = 16) -> list[tuple[int, int]]:
    """Up to `most` key ranges (both ends included) that hold every point of y0..y1, x0..x1 (ends included).

    Squares of the curve that lie inside the window are taken whole, others are quartered; then the ranges with the
    smallest gaps between them are joined, so that a filter stays short and lets few other keys in."""
    top = 1 << BITS
    y0, y1, x0, x1 = max(0, y0), min(top - 1, y1), max(0, x0), min(top - 1, x1)
    if y0 > y1 or x0 > x1:
        return []
    ranges: list[tuple[int, int]] = []
    squares = [(0, 0, BITS, 0)]  # y, x, bits of a side, first key
    while squares:
        y, x, bits, key = squares.pop()
        side = 1 << bits
        if y > y1 or y + side <= y0 or x > x1 or x + side <= x0:
            continue
        inside = y0 <= y and y + side - 1 <= y1 and x0 <= x and x + side - 1 <= x1
        if inside or bits == 0 or len(squares) + len(ranges) > 64 * most:
            ranges.append((key, key + (1 << 2 * bits) - 1))
            continue
        half = side // 2
        quarter = 1 << 2 * (bits - 1)
        squares += [(y + dy * half, x + dx * half, bits - 1, key + (2 * dy + dx) * quarter) for dy in (0, 1) for dx in (0, 1)]
    ranges.sort()
    gaps = sorted((b[0] - a[1] - 1 for a, b in zip(ranges, ranges[1:], strict=False)), reverse=True)
    least = gaps[most - 2] if len(gaps) >= most > 1 else 0
    out: list[tuple[int, int]] = []
    cuts = most - 1
    for low, high in ranges:
        gap = low - out[-1][1] - 1 if out else 0
        if out and (gap == 0 or gap < least or cuts == 0 or most == 1):
            out[-1] = (out[-1][0], high)
        else:
            cuts -= bool(out)
            out.append((low, high))
    return out


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a key lies in one of the ranges; Parquet gets it as ranges of the column."""
    out = F.lit(False)
    for k, (low, high) in enumerate(ranges):
        one = (key >= low) & (key <= high)
        out = one if k == 0 else out | one
    return out
