"""Histogram gradient-boosted trees for two classes, and isotonic calibration; plain numpy.

Training happens on the driver and takes a bounded sample only. A trained model is three small arrays over complete
binary trees, so a whole batch walks all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: per inner node a feature and a threshold (right if greater), per leaf a value."""

    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2 ** depth)
    base: float

    def margin(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        offset_inner, offset_leaf = np.arange(trees) * inner, np.arange(trees) * (inner + 1)
        feature, threshold, value = self.feature.ravel(), self.threshold.ravel(), self.value.ravel()
        out = np.full(len(x), self.base)
        for begin in range(0, len(x), rows):
            part = x[begin:begin + rows]
            line, node = np.arange(len(part))[:, None], np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                at = node + offset_inner
                node = 2 * node + 1 + (part[line, feature[at]] > threshold[at])
            out[begin:begin + rows] += value[node - inner + offset_leaf].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
                l2: float = 1.0, least: int = 8) -> Trees:
    """Depth-wise boosting of the logistic loss on binned features."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, width = x.shape
    inner = 2 ** depth - 1
    mean = (y.sum() + 1) / (n + 2)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if n == 0 or y.min() == y.max():
        return Trees(feature, threshold, value, base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    cell, margin = binned + np.arange(width) * bins, np.full(n, base)
    usable = np.zeros((width, bins), bool)
    for j, e in enumerate(edges):
        usable[j, :len(e)] = True
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, size = 2 ** level - 1, 2 ** level
            flat = ((node - first) * (width * bins))[:, None] + cell
            sums = [np.bincount(flat.ravel(), np.repeat(w, width), size * width * bins).reshape(size, width, bins).cumsum(axis=2)
                    for w in (g, h, np.ones(n))]
            (gl, hl, cl), (gt, ht, ct) = sums, [s[:, :, -1:] for s in sums]
            gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
            gain = np.where(usable & (cl >= least) & (ct - cl >= least), gain, 0).reshape(size, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(size), best] > 1e-9):
                j, b = divmod(int(best[k]), bins)
                feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = -rate * gs / (hs + l2)
        margin += value[t][leaf]
    return Trees(feature, threshold, value, base)


@dataclass(frozen=True)
class Isotonic:
    """A non-decreasing map, linear between its knots."""

    at: np.ndarray
    level: np.ndarray

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.at, self.level) if len(self.at) else np.asarray(scores, float)


def fit_isotonic(scores: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each pooled block stands at its mean score with its (smoothed) share of ones."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of scores
    for s, v in zip(np.asarray(scores, float)[order], np.asarray(y, float)[order], strict=True):
        blocks.append([1.0, v, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[2] / b[0] for b in blocks])
    level = np.array([(b[1] + 0.5 * b[1] / b[0]) / (b[0] + 0.5) for b in blocks])
    return Isotonic(at, level)
