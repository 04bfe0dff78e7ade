"""Gradient-boosted trees in numpy: histogram training with monotonic constraints, trees flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees of one depth as arrays (tree, node): a node k has children 2k+1 and 2k+2, the last level holds values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner if len(node) else False:
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.threshold[t][node])
            out += self.value[t][node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> Forest:
    """Fit to labels 0/1 by logistic loss. monotone: for each feature -1, 0 or 1; the score never moves against it.

    With one class only, or no rows, the forest is the constant log-odds (add one half to either class).
    """
    n, width = x.shape
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Forest(feature[:0], threshold[:0], value[:0], bias)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    offset = np.arange(width) * (bins + 1)
    score = np.full(n, bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            split = _best_split(code[rows], g[rows], h[rows], offset, bins, monotone, l2, low[k], high[k]) if len(rows) > 1 else None
            left, right = 2 * k + 1, 2 * k + 2
            low[[left, right]], high[[left, right]] = low[k], high[k]
            if split is None:
                node[rows] = left
                continue
            j, cut, a, b = split
            feature[t, k], threshold[t, k] = j, edges[j][cut]
            if monotone[j]:
                middle = (a + b) / 2
                (high if monotone[j] > 0 else low)[left] = middle
                (low if monotone[j] > 0 else high)[right] = middle
            node[rows] = np.where(code[rows, j] > cut, right, left)
        for leaf in range(leaves):
            k = inner + leaf
            rows = node == k
            value[t, leaf] = rate * np.clip(g[rows].sum() / (h[rows].sum() + l2), low[k], high[k])
        score += value[t][node - inner]
    return Forest(feature, threshold, value, bias)


def _best_split(code, g, h, offset, bins, monotone, l2, low, high):
    """(feature, last bin of the left side, left value, right value) of the largest gain that keeps the constraints."""
    width = code.shape[1]
    flat = (code + offset).ravel()
    sums = [np.bincount(flat, np.repeat(v, width), width * (bins + 1)).reshape(width, bins + 1) for v in (g, h, np.ones(len(g)))]
    (gl, hl, nl), (gt, ht, nt) = [s.cumsum(axis=1)[:, :-1] for s in sums], (g.sum(), h.sum(), len(g))
    a, b = np.clip(gl / (hl + l2), low, high), np.clip((gt - gl) / (ht - hl + l2), low, high)
    whole = np.clip(gt / (ht + l2), low, high)
    fit_of = lambda gs, hs, v: gs * v - 0.5 * (hs + l2) * v * v
    gain = fit_of(gl, hl, a) + fit_of(gt - gl, ht - hl, b) - fit_of(gt, ht, whole)
    sign = np.asarray(monotone)[:, None]
    gain[(nl < 5) | (nt - nl < 5) | (sign * (b - a) < 0)] = -np.inf
    j, cut = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(j), int(cut), float(a[j, cut]), float(b[j, cut])) if gain[j, cut] > 1e-9 else None
