"""Gradient-boosted trees for a few classes, over binned features, in numpy.

Trees are symmetric: all nodes of one depth ask the same question, so a row's
leaf is a number made of its answers.
"""

from __future__ import annotations

import numpy as np

_BINS = 32


class BoostedTrees:
    """Softmax boosting; ``fit`` on (rows, features), classes 0 to ``classes``-1."""

    def __init__(self, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.2, ridge: float = 2.0):
        self.classes, self.rounds, self.depth, self.rate, self.ridge = classes, rounds, depth, rate, ridge
        self.edges: list[np.ndarray] = []
        #: Per tree: class, features asked, thresholds (a bin is above or not), value of each leaf.
        self.trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = np.zeros(classes)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, _BINS + 1)[1:-1])) for k in range(x.shape[1])]
        bins = self._bins(x)
        wanted = np.eye(self.classes)[y]
        self.base = np.log(wanted.mean(0) + 1e-6)
        score = np.tile(self.base, (len(x), 1))
        for _ in range(self.rounds):
            chance = _softmax(score)
            for k in range(self.classes):
                slope, bend = wanted[:, k] - chance[:, k], chance[:, k] * (1 - chance[:, k])
                tree = self._tree(bins, slope, bend)
                score[:, k] += tree[2][_leaves(bins, tree[0], tree[1])]
                self.trees.append((k, *tree))
        return self

    def _tree(self, bins: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        leaf = np.zeros(len(bins), np.int64)
        asked, cuts = [], []
        for level in range(self.depth):
            best = (-np.inf, 0, 0)
            for f in range(bins.shape[1]):
                cell = leaf * _BINS + bins[:, f]
                g = np.bincount(cell, slope, (1 << level) * _BINS).reshape(-1, _BINS)
                h = np.bincount(cell, bend, (1 << level) * _BINS).reshape(-1, _BINS)
                low_g, low_h = np.cumsum(g, 1), np.cumsum(h, 1)
                high_g, high_h = low_g[:, -1:] - low_g, low_h[:, -1:] - low_h
                gain = (low_g**2 / (low_h + self.ridge) + high_g**2 / (high_h + self.ridge)).sum(0)[:-1]
                at = int(gain.argmax())
                if gain[at] > best[0] + 1e-9:
                    best = (gain[at], f, at)
            asked.append(best[1])
            cuts.append(best[2])
            leaf = leaf * 2 + (bins[:, best[1]] > best[2])
        size = 1 << self.depth
        value = self.rate * np.bincount(leaf, slope, size) / (np.bincount(leaf, bend, size) + self.ridge)
        return np.array(asked), np.array(cuts), value

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The chance of each class, per row."""
        bins = np.ascontiguousarray(self._bins(x).T)
        score = np.tile(self.base, (len(x), 1)).T.copy()
        for k, asked, cuts, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for f, cut in zip(asked, cuts, strict=True):
                leaf += leaf
                leaf += bins[f] > cut
            score[k] += value[leaf]
        return _softmax(score.T)


def _leaves(bins: np.ndarray, asked: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    leaf = np.zeros(len(bins), np.int64)
    for f, cut in zip(asked, cuts, strict=True):
        leaf = leaf * 2 + (bins[:, f] > cut)
    return leaf


def _softmax(score: np.ndarray) -> np.ndarray:
    up = np.exp(score - score.max(1, keepdims=True))
    return up / up.sum(1, keepdims=True)
