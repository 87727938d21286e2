"""Learners that ask for labels, or say how sure they are."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ..functions.hashing import Merand48
from .composed import Maker, _base, _stack
from .online import Kernel


@dataclass
class Confidence(Kernel):
    """What ``learn`` returns is the distance of the prediction from 0 over the base's sensitivity,
    before the example is learnt or, if asked for, after."""

    bits: int = 18
    loss: str = "logistic"
    after_training: bool = False
    make: Maker = _base

    def __post_init__(self):
        self.base = self.make(self.bits, self.loss)

    def predict(self, idx, val):
        return abs(self.base.predict(idx, val)) / max(self.base.sensitivity(idx, val), 1e-300)

    def learn(self, idx, val, y, weight):
        before = self.predict(idx, val)
        p = self.base.learn(idx, val, y, weight)
        return abs(p) / max(self.base.sensitivity(idx, val), 1e-300) if self.after_training else before

    def rows(self):
        return self.base.rows()


@dataclass
class CostRanges(Kernel):
    """Cost-sensitive active learning: a class's label is asked for if the range that its cost can
    still have is wide and begins below the best upper end. ``y`` is the list of costs."""

    classes: int = 2
    low: float = 0.0
    high: float = 1.0
    c0: float = 0.1
    c1: float = 0.5
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.slots = [self.make(self.bits, low=self.low, high=self.high) for _ in range(self.classes)]
        self.t, self.asked = 1, 0

    def ranges(self, idx, val):
        """(prediction, lower end, upper end) of each class's cost."""
        width = self.high - self.low
        delta = self.c0 * math.log(self.classes * max(self.t - 1, 1)) * width * width
        out = []
        for s in self.slots:
            p, sensitivity = s.predict(idx, val), s.sensitivity(idx, val)
            reach = [sensitivity * _importance(gap, delta, sensitivity) for gap in (p - self.low + 1, self.high + 1 - p)]
            out.append((p, max(p - reach[0], self.low), min(p + reach[1], self.high)))
        return out

    def predict(self, idx, val):
        return float(np.argmin([s.predict(idx, val) for s in self.slots]) + 1)

    def learn(self, idx, val, y, weight):
        p, ranges = self.predict(idx, val), self.ranges(idx, val)
        best_upper, eta = min(r[2] for r in ranges), self.c1 * (self.high - self.low) / math.sqrt(self.t)
        for s, (_, low, high), cost in zip(self.slots, ranges, y, strict=True):
            if cost is not None and low <= best_upper and high - low > eta:
                self.asked += 1
                s.learn(idx, val, cost, weight)
        self.t += 1
        return p

    def rows(self):
        return _stack([s.rows() for s in self.slots], self.bits)


def _importance(gap: float, delta: float, sensitivity: float, rounds: int = 20) -> float:
    """The largest weight, by bisection, whose move of the prediction keeps the growth of squared
    loss, weight * (gap^2 - (gap - weight * sensitivity)^2), within delta."""
    if sensitivity <= 0:
        return 0.0
    low, high = 0.0, gap / sensitivity
    if high * gap * gap <= delta:
        return high
    for _ in range(rounds):
        w = (low + high) / 2
        inside = w * (gap * gap - (gap - w * sensitivity) ** 2) <= delta
        low, high = (w, high) if inside else (low, w)
    return low


@dataclass
class ActiveCover(Kernel):
    """Disagreement-based active learning with a cover: where the model could still be wrong, a label
    is asked for with a probability that grows with how many of the cover's models disagree."""

    mellowness: float = 8.0
    alpha: float = 1.0
    beta_scale: float = math.sqrt(10.0)
    cover: int = 12
    oracular: bool = False
    seed: int = 0
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.base = self.make(self.bits, "logistic")
        self.models = [] if self.oracular else [self.make(self.bits, "logistic") for _ in range(self.cover)]
        self.numerator, self.denominator = np.ones(self.cover), np.full(self.cover, 1 / self.beta_scale**2)
        self.random, self.t, self.loss, self.asked = Merand48(self.seed), 0.0, 0.0, 0

    def predict(self, idx, val):
        return self.base.predict(idx, val)

    def _threshold(self):
        if self.t < 3:
            return 1.0
        return math.sqrt(self.mellowness * self.loss / self.t / self.t) + max(2 * self.alpha, 4.0) * self.mellowness * math.log(self.t) / self.t

    def _least(self):
        return 1.0 if self.t <= 2 else min(1 / (math.sqrt(self.loss) + math.log(self.t)), 0.5)

    def disputed(self, idx, val, p):
        return self.t <= 2 or abs(p) / max(self.base.sensitivity(idx, val), 1e-300) / self.t <= self._threshold()

    def asking_probability(self, idx, val, p):
        q2 = 4 * self._least() ** 2
        for model, a, b in zip(self.models, self.numerator, self.denominator, strict=False):
            q2 += ((model.predict(idx, val) > 0) != (p > 0)) * a / b
        return math.sqrt(q2) / (1 + math.sqrt(q2))

    def learn(self, idx, val, y, weight):
        p, least = self.predict(idx, val), self._least()
        disputed = self.disputed(idx, val, p)
        ask = self.asking_probability(idx, val, p) if disputed and self.t > 2 and not self.oracular else 1.0
        asked = self.t <= 2 or (disputed and (self.oracular or self.random.uniform() <= ask))
        self.loss += weight * float((p > 0) != (y > 0))
        self.t += weight
        label = y if asked or not disputed else None
        if asked:
            self.asked += 1
            self.base.learn(idx, val, y, weight / ask)
        elif not disputed:
            self.base.learn(idx, val, 1.0 if p > 0 else -1.0, weight)
        if disputed:
            # Each model of the cover learns where asking is cheap against what the ones before it cover.
            s = 2 * self.alpha**2 / least
            for k, model in enumerate(self.models):
                agrees = (model.predict(idx, val) > 0) == (p > 0)
                price = self.numerator[k] / max(self.denominator[k], 1e-12)
                if label is not None:
                    cost = s * float(label > 0) / ask, s * float(label <= 0) / ask
                    gap = cost[0] - cost[1] - (price if p > 0 else -price)
                    if gap:
                        model.learn(idx, val, -1.0 if gap < 0 else 1.0, abs(gap) * weight)
                self.numerator[k] = max(self.numerator[k] + (0.0 if agrees else 1.0), 1e-12)
                self.denominator[k] += ask * ask if agrees else 0.0
        return p

    def rows(self):
        return self.base.rows()
