"""Newton inverses of the multilinear and multicubic maps, over Arrow batches."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

TOLERANCE, STEPS = 1e-12, 100


def _basis(u: np.ndarray, cubic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weights and their slopes along one direction: (rows, nodes)."""
    if not cubic:
        one = np.ones_like(u)
        return np.stack([1 - u, u], 1), np.stack([-one, one], 1)
    w = [u * (1 - u) * (u - 2) / 6, (u * u - 1) * (u - 2) / 2, u * (u + 1) * (2 - u) / 2, u * (u * u - 1) / 6]
    s = [-(3 * u * u - 6 * u + 2) / 6, (3 * u * u - 4 * u - 1) / 2, -(3 * u * u - 2 * u - 2) / 2, (3 * u * u - 1) / 6]
    return np.stack(w, 1), np.stack(s, 1)


def _solve(a: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Determinants and solutions of many small systems, by Cramer's rule."""
    d = a.shape[1]
    if d == 1:
        det = a[:, 0, 0]
        top = r
    elif d == 2:
        det = a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] * a[:, 1, 0]
        top = np.stack([r[:, 0] * a[:, 1, 1] - a[:, 0, 1] * r[:, 1], a[:, 0, 0] * r[:, 1] - r[:, 0] * a[:, 1, 0]], 1)
    else:
        cross = np.cross(a[:, :, 1], a[:, :, 2])
        det = (a[:, :, 0] * cross).sum(axis=1)
        top = np.stack([(r * cross).sum(axis=1), (a[:, :, 0] * np.cross(r, a[:, :, 2])).sum(axis=1), (a[:, :, 0] * np.cross(a[:, :, 1], r)).sum(axis=1)], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return det, top / det[:, None]


def invert(nodes: np.ndarray, points: np.ndarray, cubic: bool) -> np.ndarray:
    """Local coordinates (rows, d) of points in cells with nodes (rows, n^d, d), first direction fastest; NaN where the steps don't settle."""
    rows, d = points.shape
    local = np.full((rows, d), 0.5)
    done, alive = np.zeros(rows, bool), np.isfinite(points).all(axis=1) & np.isfinite(nodes).all(axis=(1, 2))
    order = 4 if cubic else 2
    for _ in range(STEPS + 1):
        k = np.flatnonzero(alive & ~done)
        if not len(k):
            break
        basis = [_basis(local[k, c], cubic) for c in range(d)]
        weights = [[basis[c][0] for c in range(d)]] + [[basis[c][c == s] for c in range(d)] for s in range(d)]
        sums = []
        for ws in weights:
            term = np.ones((len(k), 1))
            for w in ws:  # the first direction stays fastest
                term = (w[:, :, None] * term[:, None, :]).reshape(len(k), -1)
            sums.append(np.einsum("rn,rnd->rd", term, nodes[k]))
        error = points[k] - sums[0]
        small = np.sqrt((error**2).sum(axis=1)) <= TOLERANCE
        done[k[small]] = True
        jacobian = np.stack(sums[1:], axis=2)
        det, solved = _solve(jacobian, error)
        bad = ~np.isfinite(det) | (det == 0)
        alive[k[bad & ~small]] = False
        go = ~small & ~bad
        local[k[go]] += solved[go]
        alive[k] &= np.isfinite(local[k]).all(axis=1)
    local[~done] = np.nan
    return local


def inverse_udf(dims: int, cubic: bool):
    """Arrow UDF (flat nodes array<double>, point array<double>) -> local coordinates array<double>, null where there are none."""
    count = (4 if cubic else 2) ** dims

    @F.arrow_udf("array<double>")
    def local(nodes: pa.Array, point: pa.Array) -> pa.Array:
        fits = pc.and_kleene(pc.equal(pc.list_value_length(nodes), count * dims), pc.equal(pc.list_value_length(point), dims))
        ok = pc.fill_null(fits, False)
        at = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
        flat = lambda x: pc.fill_null(pc.list_flatten(x.filter(ok)), float("nan")).to_numpy(zero_copy_only=False).astype(float)
        found = invert(flat(nodes).reshape(len(at), count, dims), flat(point).reshape(len(at), dims), cubic)
        good = ~np.isnan(found).any(axis=1)
        held = np.zeros(len(nodes), bool)
        held[at[good]] = True
        ends = np.r_[0, np.cumsum(held) * dims].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found[good].ravel()), mask=pa.array(~held))

    return local


def tensor_offsets(order: int, dims: int) -> list[tuple[int, ...]]:
    """Offsets of the nodes of a stencil, first direction fastest, padded to three."""
    return [tuple(reversed(t)) + (0,) * (3 - dims) for t in product(range(order), repeat=dims)]
