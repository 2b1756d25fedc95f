"""A small gradient-boosted classifier (logistic loss, trees of depth two over binned features)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Fitted on a bounded sample; scoring is vectorised and the model travels with the task."""

    def __init__(self, trees: int = 40, rate: float = 0.3, bins: int = 16):
        self.trees, self.rate, self.bins = trees, rate, bins
        self.edges: list[np.ndarray] = []
        self.model: list[tuple] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _split(b: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> tuple[float, int, int]:
        best = (0.0, 0, bins + 1)
        total_g, total_h = g.sum(), h.sum()
        for k in range(b.shape[1]):
            sg = np.bincount(b[:, k], weights=g, minlength=bins + 1).cumsum()
            sh = np.bincount(b[:, k], weights=h, minlength=bins + 1).cumsum()
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), k, at)
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        if not len(x):
            return self
        self.edges = []
        for col in x.T:  # quantiles, and a cut just over the least value however many share it
            over = col[col > col.min()]
            least = [(col.min() + over.min()) / 2] if len(over) else []
            self.edges.append(np.unique(np.concatenate([np.quantile(col, np.linspace(0, 1, self.bins)[1:-1]), least])))
        b, f = self._binned(x), np.zeros(len(x))
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        f += self.base
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            _, k, at = self._split(b, g, h, self.bins)
            left = b[:, k] <= at
            tree = [(k, at)]
            for side in (left, ~left):
                _, k2, at2 = self._split(b[side], g[side], h[side], self.bins) if side.any() else (0, 0, self.bins + 1)
                low = b[:, k2] <= at2
                values = [float(g[m].sum() / (h[m].sum() + 1)) if (m := side & part).any() else 0.0 for part in (low, ~low)]
                f += self.rate * np.where(side & low, values[0], np.where(side & ~low, values[1], 0))
                tree.append((k2, at2, *values))
            self.model.append(tuple(tree))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the class 1."""
        if not len(x) or not self.model:  # not fitted, for want of a sample: nothing is of class 1
            return np.zeros(len(x))
        b, f = self._binned(x), np.full(len(x), self.base)
        for (k, at), one, two in self.model:
            left = b[:, k] <= at
            for side, (k2, at2, low, high) in ((left, one), (~left, two)):
                f += self.rate * np.where(side, np.where(b[:, k2] <= at2, low, high), 0)
        return 1 / (1 + np.exp(-f))
