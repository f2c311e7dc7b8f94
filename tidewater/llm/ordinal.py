"""Cumulative-link (proportional odds) ordinal regression on sparse features.

``P(grade > k) = sigmoid(w . x - t_k)`` with one weight vector for all grades
and ordered thresholds ``t_0 < t_1 < ...``.  Fitted by accelerated proximal
gradient with an L1 penalty, so that a feature without evidence weighs nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Least distance of neighbouring thresholds.
GAP = 0.05
#: Features that enter a fit: in at least so many rows, with at least such a score test, at most so many.
LEAST_ROWS, LEAST_Z, MOST = 5, 5.0, 4096


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Ordinal:
    weights: dict[int, float]
    thresholds: list[float]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... by column."""
        return _sigmoid(np.asarray(score)[:, None] - np.asarray(self.thresholds)[None, :])


class Sparse:
    """Rows of (feature, value) as flat arrays over renumbered features."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        sizes = [len(f) for f, _ in rows]
        flat = np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int64)
        self.names, self.column = np.unique(flat, return_inverse=True)
        self.value = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.zeros(0)
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], minlength=len(self.names))

    def keep(self, columns: np.ndarray) -> None:
        """Only the given features stay."""
        number = np.full(len(self.names), -1)
        number[columns] = np.arange(len(columns))
        own = number[self.column] >= 0
        self.names, self.row, self.value = self.names[columns], self.row[own], self.value[own]
        self.column = number[self.column[own]]


def select_features(x: Sparse, grade: np.ndarray, least_rows: int, least_z: float, most: int) -> None:
    """Keep features whose value correlates with the grade: |z| of the score test at least ``least_z``, the ``most`` largest."""
    centered = grade - grade.mean()
    spread = np.sqrt((centered**2).mean()) or 1.0
    squares = np.bincount(x.column, x.value**2, minlength=len(x.names))
    sums = np.bincount(x.column, x.value, minlength=len(x.names))
    rows = np.bincount(x.column, minlength=len(x.names))
    variance = np.maximum(squares - sums**2 / max(1, x.n), 1e-12)
    z = np.abs(x.back(centered)) / (spread * np.sqrt(variance))
    z[rows < least_rows] = 0
    order = np.argsort(-z, kind="stable")[:most]
    x.keep(np.sort(order[z[order] >= least_z]))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]],
    grades: np.ndarray,
    l1: float = 2e-4,
    steps: int = 400,
    least_rows: int = LEAST_ROWS,
    least_z: float = LEAST_Z,
    most: int = MOST,
) -> Ordinal:
    """Fit on rows of (feature numbers, values) with integer grades from 0.

    Grades that never occur make no threshold of their own use: their
    thresholds sit next to the one below.  Without two different grades the
    model is constant.
    """
    grades = np.asarray(grades, np.int64)
    top = int(grades.max()) if len(grades) else 0
    if top == 0 or len(np.unique(grades)) < 2:
        only = int(grades[0]) if len(grades) else 0
        return Ordinal({}, [-20.0] * only + [20.0] * max(0, top - only) or [20.0])
    x = Sparse(rows)
    select_features(x, grades.astype(np.float64), least_rows, least_z, most)
    n, p = x.n, len(x.names)
    norm = np.sqrt(np.bincount(x.column, x.value**2, minlength=p) / np.maximum(1, np.bincount(x.column, minlength=p)))
    x.value = x.value / np.where(norm > 0, norm, 1.0)[x.column]
    share = np.array([(grades > k).mean() for k in range(top)])
    share = np.clip(share, 0.5 / n, 1 - 0.5 / n)
    t = -np.log(share / (1 - share)) + GAP * np.arange(top)
    w = np.zeros(p)

    def loss_gradient(w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = x.dot(w)
        upper = np.concatenate([[np.inf], -t, [-np.inf]])  # tail k of score z: sigmoid(z - t_{k-1}); tail 0 is 1
        hi, lo = _sigmoid(z + upper[grades]), _sigmoid(z + upper[grades + 1])
        hi = np.where(grades == 0, 1.0, hi)
        lo = np.where(grades == top, 0.0, lo)
        prob = np.maximum(hi - lo, 1e-12)
        dhi = np.where(grades == 0, 0.0, hi * (1 - hi))
        dlo = np.where(grades == top, 0.0, lo * (1 - lo))
        gz = -(dhi - dlo) / prob / n
        gt = np.zeros(top)
        np.add.at(gt, np.maximum(grades - 1, 0), np.where(grades == 0, 0.0, dhi / prob) / n)
        np.add.at(gt, np.minimum(grades, top - 1), np.where(grades == top, 0.0, -dlo / prob) / n)
        return -np.log(prob).mean(), x.back(gz), gt

    def ordered(t: np.ndarray) -> np.ndarray:
        ramp = GAP * np.arange(top)
        return np.maximum.accumulate(t - ramp) + ramp

    rate, wv, tv, momentum = 1.0, w.copy(), t.copy(), 1.0
    value = loss_gradient(w, t)[0]
    for _ in range(steps):
        at, gw, gt = loss_gradient(wv, tv)
        while True:
            raw = wv - rate * gw
            new_w = np.sign(raw) * np.maximum(np.abs(raw) - rate * l1, 0.0)
            new_t = ordered(tv - rate * gt)
            dw, dt = new_w - wv, new_t - tv
            found = loss_gradient(new_w, new_t)[0]
            if found <= at + gw @ dw + gt @ dt + (dw @ dw + dt @ dt) / (2 * rate) + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        new_value = found + l1 * np.abs(new_w).sum()
        if new_value > value and momentum > 1.0:  # overshot: go on from the last point without momentum
            wv, tv, momentum = w.copy(), t.copy(), 1.0
            continue
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        push = (momentum - 1) / following
        wv, tv = new_w + push * (new_w - w), ordered(new_t + push * (new_t - t))
        settled = abs(value - new_value) < 1e-8
        w, t, momentum, value = new_w, new_t, following, new_value
        if settled:
            break
    w = w / np.where(norm > 0, norm, 1.0)
    return Ordinal({int(f): float(v) for f, v in zip(x.names, w) if v}, [float(v) for v in t])
