"""Gradient-boosted trees for binary labels, on histograms, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: the feature and limit of every inner node, the value of every leaf."""

    depth: int
    base: float
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, damping: float = 1.0, least: int = 20) -> Boosted:
    """Second-order boosting of the logistic loss; splits are sought among `bins` quantiles of each feature."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(depth, float(np.log(share / (1 - share))))
    z = np.full(len(y), model.base)
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = p - y, p * (1 - p)
        feature, limit, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best, chosen = 1e-6, None
            g, h = grad[rows], hess[rows]
            gain0 = g.sum() ** 2 / (h.sum() + damping)
            for j, c in enumerate(cuts):
                if not len(c) or len(rows) < 2 * least:
                    continue
                b = binned[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + damping) + (g.sum() - gs) ** 2 / (h.sum() - hs + damping) - gain0
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, chosen = gain[k], (j, k)
            if chosen:
                feature[at], limit[at] = chosen[0], cuts[chosen[0]][chosen[1]]
                node[rows] = 2 * at + 1 + (binned[rows, chosen[0]] > chosen[1])
            else:
                node[rows] = 2 * at + 1
        for k in range(inner + 1):
            rows = node == inner + k
            if rows.any():
                leaf[k] = -rate * grad[rows].sum() / (hess[rows].sum() + damping)
        z += leaf[node - inner]
        model.features.append(feature)
        model.limits.append(limit)
        model.leaves.append(leaf)
    return model
