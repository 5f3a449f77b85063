"""Gradient-boosted trees for a binary label, in numpy: trained on a bounded sample, scored over flat node arrays.

Training is histogram-based (features cut at quantiles), with Newton steps on the logistic loss. A feature may be
given a direction (+1 or -1): splits that break it are refused and the bounds are handed down, so the score is
monotone in that feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Flat trees: node i of tree t is row ``t * size + i``; a leaf has feature -1; children are 2i+1 and 2i+2."""

    base: float
    size: int
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for first in range(0, len(self.feature), self.size):
            f, th = self.feature[first : first + self.size], self.threshold[first : first + self.size]
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = f[node] >= 0
                step = 2 * node + 1 + (x[rows, np.maximum(f[node], 0)] > th[node])
                node = np.where(inner, step, node)
            out += self.value[first : first + self.size][node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _score(g: np.ndarray, h: np.ndarray, lam: float) -> np.ndarray:
    return g * g / (h + lam)


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int] | None = None,
    rounds: int = 60,
    depth: int = 3,
    eta: float = 0.2,
    bins: int = 64,
    lam: float = 1.0,
    min_hessian: float = 1.0,
) -> Forest:
    """Fit to labels 0/1. One class only, or no rows, gives a constant forest."""
    n, width = x.shape
    size = 2 ** (depth + 1) - 1
    positive = float(y.sum())
    base = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if n == 0 or positive in (0, n):
        return Forest(base if n else 0.0, size, depth, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    direction = np.array([(monotone or {}).get(j, 0) for j in range(width)])
    key = binned + np.arange(width) * bins
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        f, th, val = np.full(size, -1), np.zeros(size), np.zeros(size)
        lower, upper = np.full(size, -np.inf), np.full(size, np.inf)
        node = np.zeros(n, np.int64)
        val[0] = grad.sum() / (hess.sum() + lam)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            active = node >= first
            if not active.any():
                break
            flat = ((node[active] - first)[:, None] * (width * bins) + key[active]).ravel()
            shape = (many, width, bins)
            gh = np.bincount(flat, np.repeat(grad[active], width), many * width * bins).reshape(shape)
            hh = np.bincount(flat, np.repeat(hess[active], width), many * width * bins).reshape(shape)
            gl, hl = gh.cumsum(2), hh.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = _score(gl, hl, lam) + _score(gr, hr, lam) - _score(gt, ht, lam)
            wl, wr = gl / (hl + lam), gr / (hr + lam)
            bad = (hl < min_hessian) | (hr < min_hessian) | (direction[None, :, None] * (wr - wl) < 0)
            gain[bad] = -np.inf
            flat_gain = gain.reshape(many, -1)
            best = flat_gain.argmax(1)
            for k in range(many):
                i = first + k
                if flat_gain[k, best[k]] <= 1e-6 or not np.isfinite(flat_gain[k, best[k]]):
                    continue
                j, b = divmod(int(best[k]), bins)
                if b >= len(cuts[j]):
                    continue
                f[i], th[i] = j, cuts[j][b]
                left, right = 2 * i + 1, 2 * i + 2
                lower[[left, right]], upper[[left, right]] = lower[i], upper[i]
                val[left] = np.clip(wl[k, j, b], lower[i], upper[i])
                val[right] = np.clip(wr[k, j, b], lower[i], upper[i])
                middle = (val[left] + val[right]) / 2
                if direction[j] > 0:
                    upper[left], lower[right] = middle, middle
                elif direction[j] < 0:
                    lower[left], upper[right] = middle, middle
            here = active & (f[node] >= 0)
            at = node[here]
            node[here] = 2 * at + 1 + (x[here, f[at]] > th[at])
        val *= eta
        margin += val[node]
        features.append(f)
        thresholds.append(th)
        values.append(val)
    return Forest(base, size, depth, np.concatenate(features), np.concatenate(thresholds), np.concatenate(values))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), non-decreasing; for interpolation."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    u, at = np.unique(score, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    mean: list[float] = []
    mass: list[float] = []
    last: list[int] = []
    for i in range(len(u)):
        m, w = total[i] / weight[i], weight[i]
        while mean and mean[-1] >= m:
            m = (m * w + mean[-1] * mass[-1]) / (w + mass[-1])
            w += mass.pop()
            mean.pop()
            last.pop()
        mean.append(m)
        mass.append(w)
        last.append(i)
    first = [0, *[k + 1 for k in last[:-1]]]
    knots = np.array([u[k] for pair in zip(first, last) for k in pair])
    return knots, np.repeat(np.array(mean), 2)
