"""Geometry as column expressions: maps between a cell and its local coordinates, containment, volumes, bounds.

A point is a list of columns (one for each dimension). The nodes of a cell are a list of 2^d points with the first direction fastest. Everything here stays
inside whole-stage code generation; divisions by zero give null, and null never counts as inside.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _all(terms) -> Column:
    return reduce(lambda a, b: a & b, terms)


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def linear_weights(u) -> list[Column]:
    return [1.0 - _c(u), _c(u)]


def linear_slopes(u) -> list[Column]:
    return [F.lit(-1.0), F.lit(1.0)]


def cubic_weights(u) -> list[Column]:
    """Lagrange weights of the nodes -1, 0, 1, 2."""
    u = _c(u)
    return [u * (1.0 - u) * (u - 2.0) / 6.0, (u * u - 1.0) * (u - 2.0) / 2.0, u * (u + 1.0) * (2.0 - u) / 2.0, u * (u * u - 1.0) / 6.0]


def cubic_slopes(u) -> list[Column]:
    u = _c(u)
    return [-(3.0 * u * u - 6.0 * u + 2.0) / 6.0, (3.0 * u * u - 4.0 * u - 1.0) / 2.0, -(3.0 * u * u - 2.0 * u - 2.0) / 2.0, (3.0 * u * u - 1.0) / 6.0]


def det2(a, b) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def det3(a, b, c) -> Column:
    return a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def solve2(a, b, r) -> list[Column]:
    """x with x0 * a + x1 * b = r, by Cramer's rule; null for dependent columns."""
    d = det2(a, b)
    return [F.try_divide(det2(r, b), d), F.try_divide(det2(a, r), d)]


def solve3(a, b, c, r) -> list[Column]:
    d = det3(a, b, c)
    return [F.try_divide(det3(r, b, c), d), F.try_divide(det3(a, r, c), d), F.try_divide(det3(a, b, r), d)]


def iso_forward(nodes, local, cubic: bool = False) -> list[Column]:
    """Point of the given local coordinates: the tensor product of weights with 2^d (or 4^d) nodes. Covers every kind of cell."""
    weights = [(cubic_weights if cubic else linear_weights)(u) for u in local]
    terms = [reduce(lambda a, b: a * b, reversed(ws)) for ws in product(*reversed(weights))]
    return [_sum(t * _c(n[d]) for t, n in zip(terms, nodes)) for d in range(len(nodes[0]))]


def inverse_uniform(low, high, p) -> list[Column]:
    """Local coordinates in an axis-aligned cell with these two corners."""
    return [F.try_divide(x - a, b - a) for a, b, x in zip(low, high, p)]


def _edges(nodes) -> list[list[Column]]:
    d = len(nodes[0])
    return [[nodes[1 << k][c] - nodes[0][c] for c in range(d)] for k in range(d)]


def inverse_oriented(nodes, p) -> list[Column]:
    """Local coordinates in a cell with perpendicular edges: the projection on each."""
    r = [x - n for x, n in zip(p, nodes[0])]
    return [F.try_divide(_sum(a * b for a, b in zip(r, e)), _sum(a * a for a in e)) for e in _edges(nodes)]


def inside_unit(local, tolerance=0.0) -> Column:
    return F.coalesce(_all((u >= -_c(tolerance)) & (u <= 1.0 + _c(tolerance)) for u in local), F.lit(False))


def _in_simplex(corners, p, tolerance) -> Column:
    first = corners[0]
    sides = [[a - b for a, b in zip(c, first)] for c in corners[1:]]
    r = [a - b for a, b in zip(p, first)]
    local = (solve2 if len(p) == 2 else solve3)(*sides, r)
    return F.coalesce(_all(u >= -_c(tolerance) for u in local) & (_sum(local) <= 1.0 + _c(tolerance)), F.lit(False))


TRIANGLES = ((0, 1, 2), (3, 2, 1))
TETRAHEDRA = ((0, 1, 2, 4), (1, 2, 4, 5), (2, 4, 5, 6), (1, 2, 5, 3), (2, 5, 3, 6), (3, 6, 5, 7))


def contains_simplices(nodes, p, tolerance=0.0) -> Column:
    """Is the point in one of the triangles or tetrahedra that the quadrilateral or hexahedron is cut into?"""
    parts = TRIANGLES if len(p) == 2 else TETRAHEDRA
    return reduce(lambda a, b: a | b, (_in_simplex([nodes[k] for k in part], p, tolerance) for part in parts))


def contains(geometry: str, nodes, p, tolerance=0.0) -> Column:
    d = len(p)
    if d == 1 or geometry in ("UNIFORM", "RECTILINEAR"):
        return inside_unit(inverse_uniform(nodes[0], nodes[-1], p), tolerance)
    if geometry in ("ORIENTED_UNIFORM", "ORIENTED_RECTILINEAR"):
        return inside_unit(inverse_oriented(nodes, p), tolerance)
    return contains_simplices(nodes, p, tolerance)


def volume(geometry: str, nodes) -> Column:
    """Signed length, area or volume of axis-aligned cells and lines; unsigned for all others."""
    d = len(nodes[0])
    if d == 1 or geometry in ("UNIFORM", "RECTILINEAR"):
        return reduce(lambda a, b: a * b, (b - a for a, b in zip(nodes[0], nodes[-1])))
    if geometry in ("ORIENTED_UNIFORM", "ORIENTED_RECTILINEAR"):
        return F.abs((det2 if d == 2 else det3)(*_edges(nodes)))
    parts, divisor, det = (TRIANGLES, 2.0, det2) if d == 2 else (TETRAHEDRA, 6.0, det3)
    return _sum(F.abs(det(*[[a - b for a, b in zip(nodes[k], nodes[part[0]])] for k in part[1:]])) for part in parts) / divisor


def bounds(nodes) -> list[tuple[Column, Column]]:
    return [(F.least(*(n[c] for n in nodes)), F.greatest(*(n[c] for n in nodes))) for c in range(len(nodes[0]))]


def nodes_of(column: str, count: int, dims: int) -> list[list[Column]]:
    """The nodes kept in an array of structs with fields x, y, z."""
    return [[F.col(column)[k]["xyz"[c]] for c in range(dims)] for k in range(count)]


def chebyshev_to_centre(local) -> Column:
    """How far the local coordinates are from the cell's middle."""
    terms = [F.abs(u - 0.5) for u in local]
    return F.greatest(*terms) if len(terms) > 1 else terms[0]


def outside_distance(local) -> Column:
    """Squared distance of the local coordinates from the unit cell."""
    return _sum(F.pow(u - F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)), F.lit(2.0)) for u in local)


def is_missing(x) -> Column:
    """Null, not a number, or infinite: such coordinates are never found."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
