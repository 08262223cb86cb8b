"""Histogram gradient-boosted trees in numpy: fitted on a bounded sample, traversed as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Complete trees of one depth: node i of a tree has the children 2i + 1 and 2i + 2.

    A row goes right where its feature is above the threshold; a node that isn't split has an infinite one. ``leaf`` has
    the 2 ** depth values of each tree. Rows of all trees are looked up at once, one level after the other.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        trees, nodes = self.feature.shape
        depth = (nodes + 1).bit_length() - 1
        total = np.full(len(x), self.start)
        base = np.arange(trees)[None, :]
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            at = np.zeros((len(part), trees), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(depth):
                at = 2 * at + 1 + (part[rows, self.feature[base, at]] > self.threshold[base, at])
            total[a : a + 4096] += self.leaf[base, at - nodes].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, least: float = 4.0, penalty: float = 2.0) -> Trees:
    """Boosted trees for the log loss. Features are binned at quantiles; a split needs ``least`` summed hessian a side.

    Equal gains go to the first feature and the lowest threshold. Without rows, or with one label only, the trees are
    empty and every score is the smoothed share of label 1.
    """
    n, width = x.shape
    nodes = 2**depth - 1
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Trees(np.zeros((1, nodes), np.int64), np.full((1, nodes), np.inf), np.zeros((1, nodes + 1)), start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    feature, threshold, leaf = np.zeros((rounds, nodes), np.int64), np.full((rounds, nodes), np.inf), np.zeros((rounds, nodes + 1))
    margin = np.full(n, start)
    offsets = np.arange(width) * BINS
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            cell = (local[:, None] * width * BINS + offsets + binned).ravel()
            g = np.bincount(cell, np.repeat(grad, width), count * width * BINS).reshape(count, width, BINS)
            h = np.bincount(cell, np.repeat(hess, width), count * width * BINS).reshape(count, width, BINS)
            gl, hl = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            gt, ht = g.sum(axis=2)[:, :, None], h.sum(axis=2)[:, :, None]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain = np.where((hl >= least) & (ht - hl >= least), gain, 0).reshape(count, -1)
            best = gain.argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), BINS - 1)
                if gain[k, best[k]] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + k], threshold[t, first + k] = j, cuts[j][b]
            at = threshold[t, node]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > at)
        local = node - nodes
        gs, hs = np.bincount(local, grad, nodes + 1), np.bincount(local, hess, nodes + 1)
        leaf[t] = rate * gs / (hs + penalty)
        margin += leaf[t][local]
    return Trees(feature, threshold, leaf, start)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Coefficients (the last is the constant) of a logistic regression, by Newton's method with halved steps."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(z.shape[1])

    def loss(w):
        m = z @ w
        return float(np.logaddexp(0, m).sum() - (y * m).sum() + 0.5 * w @ ridge @ w)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        scale = 1.0
        while scale > 1e-4 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
        if np.abs(step).max() * scale < 1e-8:
            break
    return w
