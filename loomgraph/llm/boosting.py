"""Gradient-boosted trees for two classes and isotonic calibration, on small dense matrices."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Trees as arrays: feature (-1 in leaves), threshold (left where value <= threshold), children and leaf values."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > threshold[at]
                at = np.where(inner, left[at] + right, at)
            out += value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss; splits at quantiles of each feature, gains from summed gradients in bins."""
    total = max(w.sum(), 1e-9)
    p = min(max((w * y).sum() / total, 1e-4), 1 - 1e-4)
    model = Trees(float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1) if len(x) else np.zeros(x.shape, int)
    raw = np.full(len(x), model.base)
    scale = len(w) / total
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-raw))
        g, h = w * scale * (prob - y), w * scale * np.maximum(prob * (1 - prob), 1e-9)
        feature, threshold, left, value = [-1], [0.0], [0], [0.0]
        level = [(0, np.arange(len(x)))]
        for _ in range(depth):
            below = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -rate * gs / (hs + ridge)
                best = (1e-6, -1, 0)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    code = coded[rows, f]
                    gl = np.cumsum(np.bincount(code, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code, h[rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(code, minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
                if best[1] < 0:
                    continue
                _, f, k = best
                feature[node], threshold[node], left[node] = f, float(cuts[f][k]), len(feature)
                goes = coded[rows, f] > k
                for part in (rows[~goes], rows[goes]):
                    gs, hs = g[part].sum(), h[part].sum()
                    below.append((len(feature), part))
                    feature.append(-1)
                    threshold.append(0.0)
                    left.append(0)
                    value.append(-rate * gs / (hs + ridge))
            level = below
        tree = (np.array(feature), np.array(threshold), np.array(left), np.array(value))
        model.trees.append(tree)
        raw += Trees(0.0, [tree]).raw(x)
    return model


def fit_isotonic(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone function nearest to y in weighted squares: pooled adjacent violators, joined at block means."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted y, weighted x
    for x, v, u in zip(raw[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        blocks.append([u, u * v, u * x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    xs = np.array([b[2] / b[0] for b in blocks])
    ys = np.array([b[1] / b[0] for b in blocks])
    return xs, ys
