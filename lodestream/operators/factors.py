"""Factor models as kernels: matrix factorisation by sub-models, and field-aware factors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .online import Kernel

Start = Callable[[int, int], np.ndarray]


def small_normals(seed: int = 0) -> Start:
    return lambda rows, columns: np.random.default_rng(seed).normal(size=(rows, columns)) * 0.1


@dataclass
class SplitFactors(Kernel):
    """Matrix factorisation as a linear model and ``rank`` pairs of linear models, one of the left and
    one of the right features, whose products add up. The linear part learns first, then the left
    models against what the right ones say, then the right ones; ``split`` parts the sides."""

    rank: int = 2
    rate: float = 0.05
    split: int = 1 << 17
    bits: int = 18
    start: Start = small_normals()

    def __post_init__(self):
        self.w, self.v = np.zeros(1 << self.bits), self.start(1 << self.bits, self.rank)

    def _sides(self, idx, val):
        left = idx < self.split
        return left, val[left] @ self.v[idx[left]], val[~left] @ self.v[idx[~left]]

    def predict(self, idx, val):
        _, a, b = self._sides(idx, val)
        return float(self.w[idx] @ val + a @ b)

    def learn(self, idx, val, y, weight):
        first = self.predict(idx, val)
        self.w[idx] += 2 * self.rate * weight * (y - first) * val
        for mine in (True, False):
            left, a, b = self._sides(idx, val)
            p = float(self.w[idx] @ val + a @ b)
            side = left if mine else ~left
            self.v[idx[side]] += 2 * self.rate * weight * (y - p) * np.outer(val[side], b if mine else a)
        return first

    def rows(self):
        at = np.flatnonzero(self.w)
        return at, self.w[at], np.linalg.norm(self.v[at], axis=1)


@dataclass
class FieldFactors(Kernel):
    """Field-aware factors: a feature has ``rank`` weights for each other field, and two features of
    different fields meet in the weights that each has for the other's field. ``bounds`` are the
    indices at which the fields after the first begin."""

    bounds: tuple[int, ...] = (1 << 16,)
    rank: int = 2
    rate: float = 0.05
    bits: int = 17
    start: Start = small_normals()

    def __post_init__(self):
        self.fields = len(self.bounds) + 1
        self.w = np.zeros(1 << self.bits)
        self.v = self.start(1 << self.bits, self.fields * self.rank).reshape(1 << self.bits, self.fields, self.rank)

    def _pairs(self, idx):
        field = np.searchsorted(self.bounds, idx, "right")
        return field, [(i, j) for i in range(len(idx)) for j in range(i + 1, len(idx)) if field[i] != field[j]]

    def predict(self, idx, val):
        field, pairs = self._pairs(idx)
        return float(self.w[idx] @ val) + sum(val[i] * val[j] * float(self.v[idx[i], field[j]] @ self.v[idx[j], field[i]]) for i, j in pairs)

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        step = 2 * self.rate * weight * (y - p)
        field, pairs = self._pairs(idx)
        moves = [(idx[a], field[b], step * val[i] * val[j] * self.v[idx[b], field[a]]) for i, j in pairs for a, b in ((i, j), (j, i))]
        for i, f, move in moves:
            self.v[i, f] += move
        self.w[idx] += step * val
        return p

    def rows(self):
        at = np.flatnonzero(self.w)
        return at, self.w[at], np.sqrt((self.v[at] ** 2).sum((1, 2)))
