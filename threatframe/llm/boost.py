"""Boosted trees of several classes on binned features, in numpy (operator 12).

The sample is small and bounded, so it is fitted in one process; the model is a few
arrays that tasks use to score their own nodes.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """softmax over `classes` of sums of leaves; trees of one fixed depth as arrays."""

    def __init__(self, edges: list[np.ndarray], classes: int, depth: int):
        self.edges, self.classes, self.depth = edges, classes, depth
        self.feature = np.empty((0, (1 << depth) - 1), dtype=np.int32)
        self.cut = np.empty((0, (1 << depth) - 1), dtype=np.uint8)
        self.leaf = np.empty((0, 1 << depth))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)],
                        axis=1).astype(np.uint8)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), self.classes))
        rows, flat, wide = np.arange(len(bins)) * bins.shape[1], bins.ravel(), len(self.leaf[0]) - 1 \
            if len(self.leaf) else 0
        for t in range(len(self.leaf)):
            at = np.zeros(len(bins), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (flat[rows + self.feature[t][at]] > self.cut[t][at])
            out[:, t % self.classes] += self.leaf[t][at - wide]
        return out

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        m = self.margins(self.binned(x))
        m -= m.max(axis=1, keepdims=True)
        return m - np.log(np.exp(m).sum(axis=1, keepdims=True))


def _tree(bins: np.ndarray, flags: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, l2: float):
    """Level by level: the split of the largest gain in each node (none: all rows left).

    `flags` are the features of two bins: their sums are one matrix product a level."""
    n = len(bins)
    scaled = np.flatnonzero(bins.max(axis=0, initial=0) > 1)
    yes = bins[:, flags].astype(np.float32)
    feature = np.zeros((1 << depth) - 1, dtype=np.int32)
    cut = np.full((1 << depth) - 1, 255, dtype=np.uint8)
    at = np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    for level in range(depth):
        nodes, first = 1 << level, (1 << level) - 1
        gt, ht = np.bincount(at, g, nodes)[:, None], np.bincount(at, h, nodes)[:, None]
        best = np.full(nodes, 1e-9)

        def offer(gl, hl, chosen, cuts):
            gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
            gain[(hl < 0.2) | (ht - hl < 0.2)] = 0
            top = gain.argmax(axis=1)
            value = gain[np.arange(nodes), top]
            better = value > best
            best[better] = value[better]
            feature[first:first + nodes][better] = chosen[top[better]]
            cut[first:first + nodes][better] = cuts[top[better]]

        if len(flags):
            member = np.zeros((n, nodes), dtype=np.float32)
            member[rows, at] = 1
            gl = gt - (member * g[:, None].astype(np.float32)).T @ yes
            hl = ht - (member * h[:, None].astype(np.float32)).T @ yes
            offer(gl, hl, flags, np.zeros(len(flags), dtype=np.uint8))
        for k in scaled:
            place = at * BINS + bins[:, k]
            gs = np.bincount(place, g, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
            hs = np.bincount(place, h, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
            offer(gs[:, :-1], hs[:, :-1], np.full(BINS - 1, k), np.arange(BINS - 1))
        at = 2 * at + (bins[rows, feature[first + at]] > cut[first + at])
    size = 1 << depth
    leaf = -np.bincount(at, g, size) / (np.bincount(at, h, size) + l2)
    return feature, cut, leaf, at


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int = 3, rounds: int = 25,
        depth: int = 4, rate: float = 0.3, l2: float = 1.0) -> Trees:
    """Newton boosting of the softmax loss."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
             for c in x.T]
    model = Trees(edges, classes, depth)
    bins = model.binned(x)
    flags = np.flatnonzero(bins.max(axis=0, initial=0) == 1)
    margin = np.zeros((len(x), classes))
    parts: list[tuple] = []
    for _ in range(rounds):
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        for c in range(classes):
            g, h = (p[:, c] - (y == c)) * weight, np.maximum(p[:, c] * (1 - p[:, c]), 1e-6) * weight
            feature, cut, leaf, at = _tree(bins, flags, g, h, depth, l2)
            parts.append((feature, cut, rate * leaf))
            margin[:, c] += rate * leaf[at]
    model.feature, model.cut, model.leaf = (np.stack(v) for v in zip(*parts))
    return model
