"""Column functions over index space: periodic directions, ranges, boxes, linear indices and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("i", "j", "k")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def period_number(index, begin, period) -> Column:
    """How many whole periods an index lies beyond the first."""
    return F.floor((_c(index) - begin) / _c(period)).cast("int")


def periodic_adjust(index, begin, period) -> Column:
    """The index moved by whole periods into the first one."""
    return F.pmod(_c(index) - begin, _c(period)) + begin


def map_to_range(index, begin, period, periodic, low, high) -> Column:
    """The index moved by whole periods into [low, high), or null where that isn't possible."""
    moved = index + period * (period_number(low, begin, period) - period_number(index, begin, period))
    moved = F.when(moved < low, moved + period).otherwise(moved)
    moved = F.when(_c(periodic), moved).otherwise(_c(index))
    return F.when((moved >= low) & (moved < high), moved)


def map_range(cart, r, other) -> tuple[list[tuple[Column, Column]], Column]:
    """The other range moved by whole periods so that it meets r, and whether that is possible. cart: (begin, period, periodic) of each direction.

    It stays where it is if it meets r there; else its lower corner goes into r if it can; else both begin within the first
    period and the other stays or goes one period down, direction by direction.
    """
    here = ranges_overlap(r, other)
    corner = [map_to_range(b, begin, period, periodic, lo, hi) for (begin, period, periodic), (lo, hi), (b, _) in zip(cart, r, other)]
    held = reduce(lambda x, y: x & y, (c.isNotNull() for c in corner))
    at, out = [], []
    for (begin, period, periodic), (lo, hi), (b, e) in zip(cart, r, other):
        move = lambda x, begin=begin, period=period, periodic=periodic: F.when(_c(periodic), periodic_adjust(x, begin, period)).otherwise(_c(x))
        own, size = move(lo), _c(hi) - lo
        first, width = move(b), _c(e) - b
        meets = lambda x, own=own, size=size, width=width: (x < own + size) & (own < x + width)
        down = first - F.when(_c(periodic), _c(period)).otherwise(F.lit(0))
        at.append(F.when(meets(first), first).when(meets(down), down))
    apart = reduce(lambda x, y: x & y, (x.isNotNull() for x in at)) & ~range_empty(r) & ~range_empty(other)
    possible = here | held | apart
    for (b, e), low, far in zip(other, corner, at):
        begin = F.when(here, _c(b)).when(held, low).when(apart, far)
        out.append((begin, begin + (_c(e) - b)))
    return out, possible


def concat(a, b):
    """The directions of one interval, then those of the other."""
    return [*a, *b]


def extend_local_range(r, whole, periodic, amount):
    """A part of the whole range with a halo, but not beyond sides that aren't periodic."""
    return [(F.when((_c(b) != _c(wb)) | _c(p), _c(b) - amount).otherwise(_c(b)), F.when((_c(e) != _c(we)) | _c(p), _c(e) + amount).otherwise(_c(e))) for (b, e), (wb, we), p in zip(r, whole, periodic)]


def points_of_cells(r):
    """The points of a range of cells."""
    return [(_c(b), _c(e) + 1) for b, e in r]


def with_exterior(r, whole, periodic):
    """A part with the ring of points outside the whole range, where it touches sides that aren't periodic."""
    return [(F.when((_c(b) == _c(wb)) & ~_c(p), _c(b) - 1).otherwise(_c(b)), F.when((_c(e) == _c(we)) & ~_c(p), _c(e) + 1).otherwise(_c(e))) for (b, e), (wb, we), p in zip(r, whole, periodic)]


def linear_index(i, j, k, bi, bj, bk, ni, nj) -> Column:
    """Long index within a range, i fastest."""
    return (_c(i) - bi).cast("long") + _c(ni).cast("long") * ((_c(j) - bj) + _c(nj).cast("long") * (_c(k) - bk))


def linear_index_row_major(i, j, k, bi, bj, bk, nj, nk) -> Column:
    return (_c(k) - bk).cast("long") + _c(nk).cast("long") * ((_c(j) - bj) + _c(nj).cast("long") * (_c(i) - bi))


def tuple_of(index, bi, bj, bk, ni, nj) -> tuple[Column, Column, Column]:
    """The inverse of linear_index."""
    index, ni, nj = _c(index), _c(ni).cast("long"), _c(nj).cast("long")
    i, rest = F.pmod(index, ni), F.floor(index / ni)
    return (i + bi).cast("int"), (F.pmod(rest, nj) + bj).cast("int"), (F.floor(rest / nj) + bk).cast("int")


def uniform_cell(x, origin, size) -> Column:
    """Number of the cell of a uniform lattice, rounding down."""
    return F.floor((_c(x) - origin) / size).cast("long")


# Ranges and boxes are lists of (begin, end) pairs of columns, one for each direction. Ranges are half-open, boxes closed.


def range_empty(r) -> Column:
    return reduce(lambda a, b: a | b, (_c(e) <= _c(b) for b, e in r))


def box_empty(r) -> Column:
    return reduce(lambda a, b: a | b, (_c(e) < _c(b) for b, e in r))


def intersect(a, b):
    return [(F.greatest(_c(x), _c(z)), F.least(_c(y), _c(w))) for (x, y), (z, w) in zip(a, b)]


def union(a, b, empty=range_empty):
    """The least range or box around both; an empty one doesn't count."""
    ea, eb = empty(a), empty(b)
    return [(F.when(ea, z).when(eb, x).otherwise(F.least(_c(x), _c(z))), F.when(ea, w).when(eb, y).otherwise(F.greatest(_c(y), _c(w)))) for (x, y), (z, w) in zip(a, b)]


def ranges_overlap(a, b) -> Column:
    return ~range_empty(a) & ~range_empty(b) & reduce(lambda p, q: p & q, ((_c(w) > _c(x)) & (_c(y) > _c(z)) for (x, y), (z, w) in zip(a, b)))


def boxes_overlap(a, b) -> Column:
    return ~box_empty(a) & ~box_empty(b) & reduce(lambda p, q: p & q, ((_c(w) >= _c(x)) & (_c(y) >= _c(z)) for (x, y), (z, w) in zip(a, b)))


def extend_range(r, point):
    empty = range_empty(r)
    return [(F.when(empty, p).otherwise(F.least(_c(b), _c(p))), F.when(empty, _c(p) + 1).otherwise(F.greatest(_c(e), _c(p) + 1))) for (b, e), p in zip(r, point)]


def extend_box(r, point):
    empty = box_empty(r)
    return [(F.when(empty, p).otherwise(F.least(_c(b), _c(p))), F.when(empty, p).otherwise(F.greatest(_c(e), _c(p)))) for (b, e), p in zip(r, point)]


def clamp_to_range(r, point):
    return [F.greatest(_c(b), F.least(_c(e) - 1, _c(p))) for (b, e), p in zip(r, point)]


def clamp_to_box(r, point):
    return [F.greatest(_c(b), F.least(_c(e), _c(p))) for (b, e), p in zip(r, point)]


def move_box(r, amount):
    return [(_c(b) + a, _c(e) + a) for (b, e), a in zip(r, amount)]


def grow_box(r, amount):
    empty = box_empty(r)
    return [(F.when(empty, b).otherwise(_c(b) - a), F.when(empty, e).otherwise(_c(e) + a)) for (b, e), a in zip(r, amount)]


def scale_box(r, factor):
    """About the centre."""
    return [(0.5 * (_c(b) + _c(e)) - 0.5 * _c(f) * (_c(e) - _c(b)), 0.5 * (_c(b) + _c(e)) + 0.5 * _c(f) * (_c(e) - _c(b))) for (b, e), f in zip(r, factor)]


def range_contains(r, point) -> Column:
    return reduce(lambda a, b: a & b, ((_c(p) >= _c(b)) & (_c(p) < _c(e)) for (b, e), p in zip(r, point)))


def box_contains(r, point) -> Column:
    return reduce(lambda a, b: a & b, (_c(p).between(_c(b), _c(e)) for (b, e), p in zip(r, point)))


def includes(outer, inner) -> Column:
    """Every index of the inner range lies in the outer one (an empty inner range does)."""
    return range_empty(inner) | reduce(lambda a, b: a & b, ((_c(x) >= _c(b)) & (_c(y) <= _c(e)) for (b, e), (x, y) in zip(outer, inner)))


def count(r) -> Column:
    return F.when(range_empty(r), F.lit(0).cast("long")).otherwise(reduce(lambda a, b: a * b, ((_c(e) - _c(b)).cast("long") for b, e in r)))


def box_volume(r) -> Column:
    return F.when(box_empty(r), F.lit(0.0)).otherwise(reduce(lambda a, b: a * b, (_c(e) - _c(b) for b, e in r)))


# Flags


def has(flags, bits: int) -> Column:
    return _c(flags).bitwiseAND(F.lit(bits)) != 0


def set_bits(flags, bits: int) -> Column:
    return _c(flags).bitwiseOR(F.lit(bits))


def clear_bits(flags, bits: int) -> Column:
    return _c(flags).bitwiseAND(F.lit(~bits))
