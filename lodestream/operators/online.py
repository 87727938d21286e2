"""Online learners: ordered folds over a stream of examples, as numpy kernels in Arrow groups.

A learner is a ``Kernel``: it predicts, then learns, one example at a time, in the order of an
explicit sequence column. ``train`` runs one kernel for each group (model, shard), in parallel
over groups; shards of one model are averaged as a cluster's nodes would be. A group is one
task's work and its examples are held in that task, so give a large model as many shards as its
examples need.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Squares of feature values are kept above this.
LEAST_SQUARE = 1.17549435e-38


#: Other names of losses.
ALIASES = {"absolute": "quantile", "pinball": "quantile", "classic": "squared", "log": "logistic"}


def loss_value(name: str, p: float, y: float, tau: float = 0.5) -> float:
    if name == "squared":
        return (p - y) ** 2
    if name == "hinge":
        return max(0.0, 1 - y * p)
    if name == "logistic":
        z = -y * p
        return math.log1p(math.exp(z)) if z < 30 else z
    if name == "quantile":
        e = y - p
        return tau * e if e > 0 else (tau - 1) * e
    if name == "expectile":
        e = y - p
        return (tau if e > 0 else 1 - tau) * e * e
    if name == "poisson":
        return 2 * (y * (math.log(y + 1e-6) - p) - (y - math.exp(min(p, 44.0))))
    raise ValueError(name)


def loss_slope(name: str, p: float, y: float, tau: float = 0.5) -> float:
    if name == "squared":
        return 2 * (p - y)
    if name == "hinge":
        return -y if y * p < 1 else 0.0
    if name == "logistic":
        return -y / (1 + math.exp(min(y * p, 500.0)))
    if name == "quantile":
        return -tau if y > p else (1 - tau) if y < p else 0.0
    if name == "expectile":
        return 2 * (tau if y > p else 1 - tau) * (p - y)
    if name == "poisson":
        return 2 * (math.exp(min(p, 44.0)) - y)
    raise ValueError(name)


def _lambert(x: float) -> float:
    """W(e^x) - x by Newton's method on w + log w = x."""
    w = x if x > 1 else math.exp(x) if x < -1 else 0.5671432904097838
    for _ in range(20):
        step = (w + math.log(max(w, 1e-300)) - x) / (1 + 1 / max(w, 1e-300))
        w = max(w - step, 1e-300)
        if abs(step) < 1e-12 * max(w, 1):
            break
    return w - x


def invariant_step(name: str, p: float, y: float, rate: float, per_update: float, tau: float = 0.5) -> float:
    """How far to move along the features so that the outcome is that of infinitely many small steps:
    the solution of dp/dt = -slope(p) * per_update over a time of ``rate``, over per_update."""
    if per_update <= 0:
        return -rate * loss_slope(name, p, y, tau)
    time = rate * per_update
    if name == "squared":
        return (y - p) * -math.expm1(-2 * time) / per_update
    if name == "hinge":
        gap = 1 - y * p
        return y * min(rate, gap / per_update) if gap > 0 else 0.0
    if name == "logistic":
        return _logistic_step(p, y, time) / per_update
    if name == "quantile":
        e = y - p
        if e == 0:
            return 0.0
        speed = tau if e > 0 else 1 - tau
        return math.copysign(min(speed * rate, abs(e) / per_update), e)
    if name == "expectile":
        share = tau if y > p else 1 - tau
        return (y - p) * -math.expm1(-2 * share * time) / per_update
    if name == "poisson":
        e = math.exp(min(p, 44.0))
        if y > 0:
            q = y / (1 + (y / e - 1) * math.exp(-2 * time * y))
            return (math.log(max(q, 1e-300)) - p) / per_update
        return -math.log1p(2 * time * e) / per_update
    raise ValueError(name)


def _logistic_step(p: float, y: float, time: float) -> float:
    """u + e^u = const + time for u = y p; returns the move of p."""
    u = y * p
    target = u + math.exp(min(u, 500.0)) + time
    # u' solves u' + e^{u'} = target: e^{u'} = W(e^target).
    w = _lambert(target) + target
    return y * (math.log(max(w, 1e-300)) - u)


class Kernel:
    """One model: ``predict`` and ``learn`` over (indices, values); ``rows`` gives its weights."""

    bits: int = 18

    def predict(self, idx: np.ndarray, val: np.ndarray) -> float:
        raise NotImplementedError

    def _raw(self, idx: np.ndarray, val: np.ndarray) -> float:
        """The prediction without bounds, where a learner has any."""
        return self.predict(idx, val)

    def learn(self, idx: np.ndarray, val: np.ndarray, y: float, weight: float) -> float:
        """Learns and returns the prediction made before."""
        raise NotImplementedError

    def end_pass(self) -> None:
        """What happens when all examples have been seen once more."""

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indices, weights, adaptive state) of what isn't zero."""
        raise NotImplementedError

    def load(self, idx: np.ndarray, w: np.ndarray, state: np.ndarray) -> None:
        """Goes on from what ``rows`` gave."""
        raise TypeError(f"{type(self).__name__} can't start from weights")


@dataclass
class GD(Kernel):
    """Gradient descent with the three corrections on: per-feature adaptive rates, scale-free
    normalisation, importance-invariant steps. Any of them can be off."""

    loss: str = "squared"
    rate: float = 0.5
    power: float = 0.5
    adaptive: bool = True
    normalized: bool = True
    invariant: bool = True
    l1: float = 0.0
    l2: float = 0.0
    initial_t: float = 0.0
    decay: float = 1.0
    low: float = -math.inf
    high: float = math.inf
    tau: float = 0.5
    bits: int = 18

    def __post_init__(self):
        n = 1 << self.bits
        self.loss = ALIASES.get(self.loss, self.loss)
        self.w, self.adapt, self.norm = np.zeros(n), np.zeros(n), np.zeros(n)
        self.total_weight, self.norm_sum, self.t = 0.0, 0.0, self.initial_t
        self.seen_low, self.seen_high = 0.0, 0.0

    def _raw(self, idx, val) -> float:
        w = self.w[idx]
        if self.l1:
            w = np.sign(w) * np.maximum(np.abs(w) - self.l1 * self.rate, 0)
        return float(w @ val)

    def predict(self, idx, val) -> float:
        p = self._raw(idx, val)
        low, high = max(self.low, self.seen_low if self.loss == "squared" else -50.0), min(self.high, self.seen_high if self.loss == "squared" else 50.0)
        return 0.0 if math.isnan(p) else min(max(p, low), high) if low <= high else 0.0

    def sensitivity(self, idx, val) -> float:
        """Change of the prediction for a unit step."""
        return float(self._rates(idx, np.maximum(val * val, LEAST_SQUARE)) @ (val * val)) * self._multiplier()

    def _rates(self, idx, x2) -> np.ndarray:
        rate = np.ones(len(idx))
        if self.adaptive:
            rate *= np.power(np.maximum(self.adapt[idx], 1e-300), -self.power)
        if self.normalized:
            norm = np.where(self.norm[idx] > 0, self.norm[idx], np.sqrt(x2))
            rate *= np.power(norm * norm, (self.power if self.adaptive else 0) - 1)
        return rate

    def _multiplier(self) -> float:
        if not self.normalized or self.norm_sum <= 0:
            return 1.0
        ratio = self.total_weight / self.norm_sum
        return math.pow(ratio, 1 - self.power) if self.adaptive else ratio

    def learn(self, idx, val, y, weight) -> float:
        self.seen_low, self.seen_high = min(self.seen_low, y), max(self.seen_high, y)
        p = self.predict(idx, val)
        self.t += weight
        self.total_weight += weight
        slope = loss_slope(self.loss, p, y, self.tau)
        x2 = np.maximum(val * val, LEAST_SQUARE)
        if self.normalized:
            size, norm = np.sqrt(x2), self.norm[idx]
            grown = size > norm
            if grown.any():
                # A feature that outgrows its scale has its weight rescaled to the new one.
                old = grown & (norm > 0)
                shrink = np.where(old, norm / size, 1.0)
                self.w[idx] *= np.where(old, shrink if self.adaptive else shrink * shrink, 1.0)
                self.norm[idx] = np.maximum(norm, size)
            self.norm_sum += weight * float((x2 / self.norm[idx] ** 2).sum())
        if loss_value(self.loss, p, y, self.tau) <= 0 or slope == 0:
            return p
        if self.adaptive:
            self.adapt[idx] += weight * slope * slope * x2
        rates = self._rates(idx, x2)
        multiplier = self._multiplier()
        per_update = float(rates @ x2) * multiplier
        rate = self.rate * weight * (1.0 if self.adaptive else math.pow(max(self.t, 1e-12), -self.power))
        step = invariant_step(self.loss, p, y, rate, per_update, self.tau) if self.invariant else -rate * slope
        if self.l2:
            self.w[idx] *= 1 - self.l2 * rate
        self.w[idx] += step * multiplier * rates * val
        return p

    def end_pass(self):
        self.rate *= self.decay

    def rows(self):
        at = np.flatnonzero((self.w != 0) | (self.adapt != 0))
        return at, self.w[at], self.adapt[at]

    def load(self, idx, w, state):
        """Plain and adaptive steps go on as if they had not stopped; the scales of normalised ones are met anew."""
        at = np.asarray(idx, np.int64)
        self.w[at], self.adapt[at] = w, np.nan_to_num(np.asarray(state, np.float64))


@dataclass
class FTRL(Kernel):
    """Follow the regularised leader, proximal: per feature (z, n), weights shrunk to 0 by l1."""

    loss: str = "logistic"
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    bits: int = 18

    def __post_init__(self):
        n = 1 << self.bits
        self.z, self.n = np.zeros(n), np.zeros(n)

    def _weights(self, idx):
        z, n = self.z[idx], self.n[idx]
        return np.where(np.abs(z) <= self.l1, 0.0, -np.sign(z) * (np.abs(z) - self.l1) / (self.l2 + (self.beta + np.sqrt(n)) / self.alpha))

    def predict(self, idx, val):
        return float(self._weights(idx) @ val)

    def learn(self, idx, val, y, weight):
        w = self._weights(idx)
        p = float(w @ val)
        g = loss_slope(self.loss, p, y) * weight * val
        after = self.n[idx] + g * g
        self.z[idx] += g - (np.sqrt(after) - np.sqrt(self.n[idx])) / self.alpha * w
        self.n[idx] = after
        return p

    def rows(self):
        at = np.flatnonzero(self.z)
        return at, self._weights(at), self.n[at]


@dataclass
class Pistol(Kernel):
    """Parameter-free descent: a weight is a function of its summed gradients, their sizes and the largest value."""

    loss: str = "logistic"
    alpha: float = 1.0
    beta: float = 0.5
    bits: int = 18

    def __post_init__(self):
        n = 1 << self.bits
        self.theta, self.size, self.most = np.zeros(n), np.zeros(n), np.zeros(n)

    def _weights(self, idx):
        theta, scale = self.theta[idx], self.alpha * self.most[idx] * (self.size[idx] + self.most[idx])
        ok = scale > 0
        scale = np.where(ok, scale, 1.0)
        return np.where(ok, np.sqrt(self.size[idx]) * self.beta * theta * np.exp(np.minimum(theta * theta / (2 * scale), 500)) / scale, 0.0)

    def predict(self, idx, val):
        return float(self._weights(idx) @ val)

    def learn(self, idx, val, y, weight):
        self.most[idx] = np.maximum(self.most[idx], np.abs(val))
        p = self.predict(idx, val)
        g = loss_slope(self.loss, p, y) * weight * val
        self.theta[idx] -= g
        self.size[idx] += np.abs(g)
        return p

    def rows(self):
        at = np.flatnonzero(self.theta)
        return at, self._weights(at), self.size[at]


@dataclass
class Coin(Kernel):
    """Coin betting: each feature bets a share of its wealth on the sign of the next gradient."""

    loss: str = "logistic"
    alpha: float = 4.0
    bits: int = 18

    def __post_init__(self):
        n = 1 << self.bits
        self.z, self.size, self.most, self.value, self.wealth = (np.zeros(n) for _ in range(5))
        self.norm, self.total = 0.0, 0.0

    def _weights(self, idx):
        m, x = self.most[idx], self.value[idx]
        scale = m * x * (m * x + self.size[idx])
        ok = scale > 0
        return np.where(ok, (self.alpha + self.wealth[idx]) / np.where(ok, scale, 1.0) * self.z[idx], 0.0)

    def predict(self, idx, val):
        average = self.norm / self.total if self.total else 1.0
        return float(self._weights(idx) @ val) / max(average, 1e-12)

    def learn(self, idx, val, y, weight):
        self.value[idx] = np.maximum(self.value[idx], np.abs(val))
        self.norm += weight * float(((val / np.maximum(self.value[idx], 1e-300)) ** 2).sum())
        self.total += weight
        w, p = self._weights(idx), self.predict(idx, val)
        g = loss_slope(self.loss, p, y) * weight
        self.most[idx] = np.maximum(self.most[idx], abs(g))
        self.z[idx] -= g * val
        self.size[idx] += np.abs(g * val)
        self.wealth[idx] += np.maximum(-g * val * w, -0.5 * self.wealth[idx])
        return p

    def rows(self):
        at = np.flatnonzero(self.z)
        return at, self._weights(at), self.size[at]


@dataclass
class FreeGrad(Kernel):
    """Scale-free and parameter-free: weights grow as exp(G^2 / V) and start over when gradients outgrow their scale."""

    loss: str = "logistic"
    epsilon: float = 1.0
    restart: bool = False
    radius: float = math.inf
    bits: int = 18

    def __post_init__(self):
        n = 1 << self.bits
        self.g, self.v, self.h1, self.ht, self.s = (np.zeros(n) for _ in range(5))

    def _weights(self, idx):
        g, v, h1, ht = np.abs(self.g[idx]), self.v[idx], self.h1[idx], self.ht[idx]
        ok = (h1 > 0) & (v > 0)
        v, h1 = np.where(ok, v, 1.0), np.where(ok, h1, 1.0)
        size = self.epsilon * g * (2 * v + ht * g) * h1 * h1 / (2 * (v + ht * g) ** 2 * np.sqrt(v)) * np.exp(np.minimum(g * g / (2 * v + 2 * ht * g), 500))
        return np.where(ok, -np.sign(self.g[idx]) * np.minimum(size, self.radius), 0.0)

    def predict(self, idx, val):
        return float(self._weights(idx) @ val)

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        g = loss_slope(self.loss, p, y) * weight * val
        size, before = np.abs(g), self.ht[idx]
        fresh = (self.h1[idx] == 0) & (size > 0)
        self.h1[idx] = np.where(fresh, size, self.h1[idx])
        clipped = np.where((size > before) & (before > 0), np.sign(g) * before, g)
        self.ht[idx] = np.maximum(before, size)
        if self.restart:
            out = (self.h1[idx] > 0) & (self.ht[idx] / np.maximum(self.h1[idx], 1e-300) > self.s[idx] + 2)
            for state, value in ((self.g, 0.0), (self.v, 0.0)):
                state[idx] = np.where(out, value, state[idx])
            self.h1[idx] = np.where(out, self.ht[idx], self.h1[idx])
        self.s[idx] += np.where(self.ht[idx] > 0, np.abs(clipped) / np.maximum(self.ht[idx], 1e-300), 0)
        self.g[idx] += clipped
        self.v[idx] += clipped * clipped
        return p

    def rows(self):
        at = np.flatnonzero(self.g)
        return at, self._weights(at), self.v[at]


@dataclass
class SVRG(Kernel):
    """Variance-reduced steps around a stable point whose exact gradient is taken every ``stage + 1`` passes."""

    loss: str = "squared"
    rate: float = 0.05
    stage: int = 1
    bits: int = 18

    def __post_init__(self):
        n = 1 << self.bits
        self.w, self.stable, self.full = np.zeros(n), np.zeros(n), np.zeros(n)
        self.passes, self.count = 0, 0

    def predict(self, idx, val):
        return float(self.w[idx] @ val)

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        at_stable = loss_slope(self.loss, float(self.stable[idx] @ val), y) * weight
        if self.passes % (self.stage + 1) == 0:
            self.full[idx] += at_stable * val
            self.count += 1
        else:
            inner = loss_slope(self.loss, p, y) * weight
            self.w[idx] -= self.rate * ((inner - at_stable) * val + self.full[idx] / max(self.count, 1))
        return p

    def end_pass(self):
        self.passes += 1
        if self.passes % (self.stage + 1) == 0:
            self.stable, self.full, self.count = self.w.copy(), np.zeros_like(self.w), 0

    def rows(self):
        at = np.flatnonzero(self.w)
        return at, self.w[at], self.w[at] * 0


@dataclass
class NeuralNet(Kernel):
    """One hidden layer of tanh units over the hashed features, trained by adaptive descent."""

    units: int = 4
    loss: str = "logistic"
    rate: float = 0.3
    dropout: bool = False
    seed: int = 0
    bits: int = 14

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.rng = rng
        self.a = rng.normal(size=(1 << self.bits, self.units)) * 0.1
        self.b = rng.normal(size=self.units) * 0.1
        self.ga, self.gb = np.full_like(self.a, 1e-8), np.full_like(self.b, 1e-8)

    def _hidden(self, idx, val):
        return np.tanh(val @ self.a[idx])

    def predict(self, idx, val):
        return float(self._hidden(idx, val) @ self.b) * (0.5 if self.dropout else 1)

    def learn(self, idx, val, y, weight):
        h = self._hidden(idx, val)
        out = self.predict(idx, val)
        mask = self.rng.integers(0, 2, self.units) if self.dropout else 1
        d = loss_slope(self.loss, float((h * mask) @ self.b), y) * weight
        gb = d * h * mask
        ga = np.outer(val, d * self.b * mask * (1 - h * h))
        self.gb += gb * gb
        self.ga[idx] += ga * ga
        self.b -= self.rate * gb / np.sqrt(self.gb)
        self.a[idx] -= self.rate * ga / np.sqrt(self.ga[idx])
        return out

    def rows(self):
        at = np.arange(self.units)
        return at, self.b, self.gb


@dataclass
class Factors(Kernel):
    """Matrix factorisation by descent: features of the first half of an example meet those of the
    second in ``rank`` factors; ``split`` is the index that parts the two sides. ``start`` makes the
    first factors (rows, rank), small normal ones if it isn't given."""

    rank: int = 4
    rate: float = 0.05
    l2: float = 0.0
    split: int = 1 << 17
    seed: int = 0
    bits: int = 18
    start: Callable[[int, int], np.ndarray] | None = None

    def __post_init__(self):
        self.v = self.start(1 << self.bits, self.rank) if self.start else np.random.default_rng(self.seed).normal(size=(1 << self.bits, self.rank)) * 0.1
        self.w = np.zeros(1 << self.bits)

    def predict(self, idx, val):
        left = idx < self.split
        return float(self.w[idx] @ val + (val[left] @ self.v[idx[left]]) @ (val[~left] @ self.v[idx[~left]]))

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        d = 2 * (p - y) * weight * self.rate
        left = idx < self.split
        a, b = val[left] @ self.v[idx[left]], val[~left] @ self.v[idx[~left]]
        self.w[idx] -= d * val + self.rate * self.l2 * self.w[idx]
        self.v[idx[left]] -= d * np.outer(val[left], b) + self.rate * self.l2 * self.v[idx[left]]
        self.v[idx[~left]] -= d * np.outer(val[~left], a) + self.rate * self.l2 * self.v[idx[~left]]
        return p

    def rows(self):
        at = np.flatnonzero(self.w)
        return at, self.w[at], np.linalg.norm(self.v[at], axis=1)


@dataclass
class Noop(Kernel):
    def predict(self, idx, val):
        return 0.0

    def learn(self, idx, val, y, weight):
        return 0.0

    def rows(self):
        none = np.zeros(0)
        return none.astype(np.int64), none, none


LEARNERS: dict[str, type[Kernel]] = {"gd": GD, "ftrl": FTRL, "pistol": Pistol, "coin": Coin, "freegrad": FreeGrad, "svrg": SVRG, "nn": NeuralNet, "mf": Factors, "noop": Noop}


@dataclass
class Run:
    """How to train: which kernel, over how many passes, with every ``holdout``-th example held out
    (or those after the ``holdout_after``-th); ``patience`` bad passes end it. ``save_per_pass`` also
    gives the weights after each pass but the last."""

    make: Callable[[], Kernel]
    passes: int = 1
    holdout: int = 0
    patience: int = 0
    holdout_after: int = 0
    save_per_pass: bool = False
    columns: tuple[str, ...] = field(default=("seq", "idx", "val", "y", "weight"))

    def is_out(self, n: int) -> bool:
        return bool(self.holdout_after and n > self.holdout_after) or bool(not self.holdout_after and self.holdout and n % self.holdout == 0)


class _Lists:
    """The rows of an Arrow list column as slices of one numpy array."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, kind):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null([])
        self.flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
        self.off = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.off[k] : self.off[k + 1]]


def train(examples: DataFrame, run: Run, group: list[str], start: DataFrame | None = None) -> DataFrame:
    """(group..., kind, seq, idx, p, w, state): a ``prediction`` row for each example, made before it was
    learnt in the first pass, and ``weight`` rows of the model after the last; with ``save_per_pass``
    also ``pass`` rows, whose ``seq`` is the number of the pass that they follow.

    ``examples`` has (group..., seq, idx array<long>, val array<double>, y, weight); a null label is
    only predicted. ``start`` (group..., idx, w, state) are weights and state to go on from. Split a
    large model over shards by adding a shard column to ``group`` and average with ``batch.merge``:
    a group is one task's work."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.select(*group).schema)
    schema = f"{keys}, kind string, seq long, idx long, p double, w double, state double"

    def fold(key: tuple, table: pa.Table, before: pa.Table | None = None) -> pa.Table:
        model = run.make()
        if before is not None and before.num_rows:
            model.load(*(before[c].to_numpy(zero_copy_only=False) for c in ("idx", "w", "state")))
        table = table.select(["seq", "idx", "val", "y", "weight"]).sort_by("seq")
        idx, val = _Lists(table["idx"], np.int64), _Lists(table["val"], np.float64)
        y, weight, n = table["y"].to_pylist(), table["weight"].to_pylist(), table.num_rows
        first = np.zeros(n)
        saved, best, bad = [], math.inf, 0
        for k in range(max(run.passes, 1)):
            held = 0.0
            for j in range(n):
                out, label = run.is_out(j + 1), y[j]
                p = model.predict(idx[j], val[j]) if label is None or out else model.learn(idx[j], val[j], label, weight[j])
                if out and label is not None:
                    held += weight[j] * (p - label) ** 2
                if k == 0:
                    first[j] = p
            model.end_pass()
            if run.save_per_pass and k + 1 < run.passes:
                saved.append((k + 1, *model.rows()))
            if (run.holdout or run.holdout_after) and run.patience:
                best, bad = (held, 0) if held < best else (best, bad + 1)
                if bad >= run.patience:
                    break
        parts = [("pass", *x) for x in saved] + [("weight", None, *model.rows())]
        at, w, state = (np.concatenate([np.asarray(x[k]) for x in parts]) for k in (2, 3, 4))
        sizes, m = [len(x[2]) for x in parts], len(at)
        cols = {name: pa.array([v.as_py() if hasattr(v, "as_py") else v] * (n + m), t) for (name, t), v in zip(types, key, strict=True)}
        cols |= {
            "kind": pa.array(["prediction"] * n + [x[0] for x, s in zip(parts, sizes, strict=True) for _ in range(s)]),
            "seq": pa.concat_arrays([table["seq"].combine_chunks().cast(pa.int64()), pa.array([x[1] for x, s in zip(parts, sizes, strict=True) for _ in range(s)], pa.int64())]),
            "idx": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(at.astype(np.int64))]),
            "p": pa.concat_arrays([pa.array(first), pa.nulls(m, pa.float64())]),
            "w": pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(w.astype(np.float64))]),
            "state": pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(state.astype(np.float64))]),
        }
        return pa.table(cols)

    from pyspark.sql.pandas.types import to_arrow_schema

    types = [(f.name, f.type) for f in to_arrow_schema(examples.select(*group).schema)]
    if start is None:
        return examples.groupBy(*group).applyInArrow(lambda key, table: fold(key, table), schema)
    both = examples.groupBy(*group).cogroup(start.select(*group, "idx", "w", "state").groupBy(*group))
    return both.applyInArrow(lambda key, table, before: fold(key, table, before), schema)


def hashed(df: DataFrame, features: str, bits: int = 18) -> DataFrame:
    """``df`` with ``idx`` and ``val`` for an array<struct<ns, name, value>> column: the distinct names
    of an Arrow batch are hashed together."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    from ..functions.hashing import name_hashes

    mask = (1 << bits) - 1

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.names.index(features))
            lists = lists.fill_null([]) if lists.null_count else lists
            flat = lists.flatten()
            ns, name = (flat.field(k).fill_null("").dictionary_encode() for k in ("ns", "name"))
            spaces = ns.dictionary.to_pylist()
            seeds = np.where([bool(x) for x in spaces], name_hashes(spaces, 0), 0).astype(np.int64) if spaces else np.zeros(0, np.int64)
            pair = ns.indices.to_numpy().astype(np.int64) * max(len(name.dictionary), 1) + name.indices.to_numpy()
            distinct, back = np.unique(pair, return_inverse=True)
            words = name.dictionary.to_pylist()
            made = name_hashes([words[k % max(len(words), 1)] for k in distinct], seeds[distinct // max(len(words), 1)] if len(distinct) else 0)
            off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            idx = pa.ListArray.from_arrays(pa.array(off), pa.array((made.astype(np.int64) & mask)[back] if len(back) else np.zeros(0, np.int64)))
            val = pa.ListArray.from_arrays(pa.array(off), flat.field("value").cast(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, idx, val], [*batch.schema.names, "idx", "val"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("idx", ArrayType(LongType())), StructField("val", ArrayType(DoubleType()))]))


#: Most weights that are broadcast to score with.
MOST_SENT = 4_000_000


def scored(examples: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Batch scoring with a trained model's ``weight`` rows: one join by index, the weights broadcast if
    counted small (the constant is in every example, so the other way would meet it in one task)."""
    rows = examples.select(key, F.explode(F.arrays_zip("idx", "val")).alias("z")).select(key, "z.idx", "z.val")
    own = weights.where("kind = 'weight'").select("idx", "w")
    own = F.broadcast(own) if own.count() <= MOST_SENT else own
    return rows.join(own, "idx").groupBy(key).agg(F.sum(F.col("val") * F.col("w")).alias("score"))
