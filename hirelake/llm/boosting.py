"""Gradient-boosted regression trees on the logistic loss, and isotonic calibration, in numpy.

Made for a bounded training sample of dense features: it fits on the driver in seconds, and a
fitted model is a few kilobytes that travel with the scoring function.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Boosted:
    """Trees as arrays: feature, threshold, leaf value; node i's children are 2i+1 and 2i+2."""

    base: float = 0.0
    depth: int = 3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.12, least: int = 4, ridge: float = 2.0) -> Boosted:
    """Newton boosting on binned features; a split needs ``least`` rows on both sides."""
    prior = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(prior / (1 - prior))), depth)
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    width, columns = BINS, np.arange(x.shape[1])
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        feature, threshold, value = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(2 ** (depth + 1) - 1)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(node == at)
                if len(mine) >= 2 * least:
                    code = (binned[mine] + columns * width).ravel()
                    size = width * len(columns)
                    grow = lambda v: np.bincount(code, np.repeat(v[mine], len(columns)), size).reshape(-1, width).cumsum(1)  # noqa: B023, E731
                    g, h, n = grow(gradient), grow(weight), grow(np.ones(len(y)))
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                    gain[(n < least) | (n[:, -1:] - n < least)] = 0
                    best = int(gain.argmax())
                    f, b = divmod(best, width)
                    if gain[f, b] > 1e-9 and b < len(edges[f]):
                        feature[at], threshold[at] = f, edges[f][b]
                node[mine] = 2 * at + 1 + (x[mine, feature[at]] > threshold[at])
        for at in range(2**depth - 1, 2 ** (depth + 1) - 1):
            mine = node == at
            value[at] = rate * gradient[mine].sum() / (weight[mine].sum() + ridge)
        model.trees.append((feature, threshold, value))
        margin += value[node]
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (knots, levels), to be read by linear interpolation.

    Equal scores are pooled first; each pool's level takes half a row of its own mean's complement
    (a level of 0 or 1 would claim certainty that no sample supports).
    """
    knots, where = np.unique(score, return_inverse=True)
    weight = np.bincount(where).astype(float)
    total = np.bincount(where, y)
    pools: list[list[float]] = []  # sum, weight, first, last
    for i in range(len(knots)):
        pools.append([total[i], weight[i], i, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2], last]
    at, level = [], []
    for s, w, first, last in pools:
        value = (s + 0.5 * (s > 0) * (s < w) + 0.25 * (s == 0)) / (w + 0.5) if w else 0.0
        for i in {int(first), int(last)}:
            at.append(knots[i])
            level.append(value)
    order = np.argsort(at, kind="stable")
    return np.array(at)[order], np.maximum.accumulate(np.array(level)[order]) if at else np.array([])
