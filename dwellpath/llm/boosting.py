"""Gradient-boosted trees for a yes or no, with logistic loss: small, by histograms of quantile bins.

The rows may be anywhere: ``grow`` asks for sums over them, by node, feature and bin, and never sees
a row. The sums are whole numbers, so they are the same in whatever order rows are added up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BINS, DEPTH, ROUNDS, RATE = 32, 3, 60, 0.2
#: Added to each sum of second derivatives; and no side of a split has less than this of it.
SMOOTH, LEAST = 1.0, 2.0
#: Sums of derivatives are in units of one 2**30th.
UNIT = 1 << 30


@dataclass
class Trees:
    """Complete binary trees: at each inner node a feature and the value up to which rows go left; a value at each leaf."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for f, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = descend(x, f, limit, (inner + 1).bit_length() - 1)
            out += leaf[node - inner] if len(node) else 0
        return out


def descend(x: np.ndarray, feature: np.ndarray, limit: np.ndarray, levels: int) -> np.ndarray:
    """The node of a tree that each row is at after so many levels."""
    rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
    return node


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bin_cuts(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Values that part a feature's distinct ``values``, in order, into at most ``bins`` bins of about equal weight."""
    at = np.searchsorted(np.cumsum(weights), np.linspace(0, 1, bins + 1)[1:-1] * np.sum(weights))
    return np.unique(values[np.minimum(at, len(values) - 1)])


def codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: one up to cut k has a code up to k."""
    return np.array([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]).T


def sums(code: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: Trees, feature: np.ndarray, limit: np.ndarray, level: int, bins: int = BINS) -> np.ndarray:
    """First and second derivatives, in units, of rows of weight ``w``, by node of the level, feature and bin."""
    m, nodes = x.shape[1], 2**level
    p = sigmoid(trees.raw(x))
    here = descend(x, feature, limit, level) - (nodes - 1)
    cell = ((here[:, None] * m + np.arange(m)) * bins + code).ravel()
    out = np.zeros((2, nodes * m * bins), dtype=np.int64)
    for k, v in enumerate((w * (p - y), w * p * (1 - p))):
        # whole numbers below 2**53 are added without error, as some thousand rows are at a time
        out[k] = np.bincount(cell, np.repeat(np.rint(v * UNIT), m), out.shape[1]).astype(np.int64)
    return out.reshape(2, nodes, m, bins)


def grow(summed: Callable[[Trees, np.ndarray, np.ndarray, int], np.ndarray], cuts: list[np.ndarray], share: float, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Trees for rows of which ``share`` are true; ``summed(trees, feature, limit, level)`` gives the sums of ``sums`` over all rows."""
    m, inner = len(cuts), 2**depth - 1
    odds = np.clip(share, 0.01, 0.99)
    trees = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**depth)), float(np.log(odds / (1 - odds))))
    ends = np.array([len(c) for c in cuts])
    for _ in range(rounds):
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        leaf = np.zeros(2**depth)
        for level in range(depth):
            first = 2**level - 1
            found = summed(trees, feature, limit, level) / UNIT
            for k in range(2**level):
                left = found[:, k].cumsum(axis=2)
                total = left[:, 0, -1]
                right = total[:, None, None] - left
                gain = left[0] ** 2 / (left[1] + SMOOTH) + right[0] ** 2 / (right[1] + SMOOTH) - total[0] ** 2 / (total[1] + SMOOTH)
                gain[(left[1] < LEAST) | (right[1] < LEAST) | (np.arange(left.shape[2]) >= ends[:, None])] = 0
                f, cut = divmod(int(gain.argmax()), left.shape[2])
                sides = total, total * 0
                if gain[f, cut] > 1e-6:
                    feature[first + k], limit[first + k] = f, cuts[f][cut]
                    sides = left[:, f, cut], right[:, f, cut]
                if level == depth - 1:
                    leaf[2 * k : 2 * k + 2] = [-g / (h + SMOOTH) * rate for g, h in sides]
        trees = Trees(np.vstack([trees.feature, feature]), np.vstack([trees.limit, limit]), np.vstack([trees.leaf, leaf]), trees.base)
    return trees


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Fit to rows ``x`` and labels ``y`` in memory."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    cuts = [bin_cuts(*np.unique(c, return_counts=True)) for c in x.T]
    code = codes(x, cuts)
    return grow(lambda trees, feature, limit, level: sums(code, x, y, np.ones(len(y)), trees, feature, limit, level), cuts, y.mean(), rounds, depth, rate)


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 60, w: np.ndarray | None = None) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * z + b) fits the labels of rows that the trees haven't seen, of weight ``w``; by Newton steps."""
    w = np.ones(len(z)) if w is None else w
    a, b = 1.0, 0.0
    up, down = (w * y).sum(), (w * (1 - y)).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = np.array([(w * (p - target) * z).sum(), (w * (p - target)).sum()])
        s = w * p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def threshold(p: np.ndarray, y: np.ndarray, precision: float, w: np.ndarray | None = None) -> float:
    """The lowest probability, but a half at least, from which on the share of true rows, by weight, reaches ``precision``."""
    order = np.argsort(-p, kind="stable")
    w = np.ones(len(p)) if w is None else w[order]
    share = np.cumsum(w * y[order]) / np.cumsum(w)
    last = np.append(p[order][1:] != p[order][:-1], True)  # rows of one probability go together
    good = np.flatnonzero((share >= precision) & last)
    return max(0.5, float(p[order][good[-1]])) if len(good) else 1.1
