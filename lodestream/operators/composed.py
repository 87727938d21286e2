"""Learners composed of base kernels: multiclass, bandit, structured and tree reductions, each a
``Kernel``-like object that a group's fold drives. What they share is a base learner for each slot."""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions.hashing import Merand48
from .online import GD, Kernel, loss_slope


def _base(bits: int, loss: str = "squared", **more) -> Kernel:
    return GD(loss=loss, bits=bits, **more)


def plain(rate: float = 0.1) -> Callable[..., Kernel]:
    """A maker of base learners by plain gradient steps of one size."""
    return lambda bits, loss="squared", **more: GD(loss=loss, bits=bits, rate=rate, power=0.0, adaptive=False, normalized=False, invariant=False, **more)


#: What a composed learner makes its base learners with: (bits, loss, other options).
Maker = Callable[..., Kernel]


@dataclass
class OneAgainstAll(Kernel):
    """k binary problems; the class with the largest score, the lowest of ties."""

    classes: int = 2
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.slots = [self.make(self.bits, "logistic") for _ in range(self.classes)]

    def scores(self, idx, val):
        return [s.predict(idx, val) for s in self.slots]

    def predict(self, idx, val):
        return float(np.argmax(self.scores(idx, val)) + 1)

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        for k, s in enumerate(self.slots, 1):
            s.learn(idx, val, 1.0 if y == k else -1.0, weight)
        return p

    def rows(self):
        parts = [s.rows() for s in self.slots]
        return np.concatenate([a + (k << self.bits) for k, (a, _, _) in enumerate(parts)]), np.concatenate([w for _, w, _ in parts]), np.concatenate([x for _, _, x in parts])


@dataclass
class MultilabelOneAgainstAll(OneAgainstAll):
    """A binary problem for each class; ``y`` is the list of an example's classes (from 1). A
    prediction is the set of classes that score above 0, as the sum of 2^(class - 1)."""

    def predict(self, idx, val):
        return float(sum(1 << k for k, x in enumerate(self.scores(idx, val)) if x > 0))

    def learn(self, idx, val, y, weight):
        p, own = self.predict(idx, val), set(y)
        for k, s in enumerate(self.slots, 1):
            s.learn(idx, val, 1.0 if k in own else -1.0, weight)
        return p


@dataclass
class Bootstrap(Kernel):
    """Replicas that see each example a Poisson(1) number of times; the mean of what they predict, or the most frequent."""

    replicas: int = 4
    kind: str = "mean"
    loss: str = "squared"
    seed: int = 0
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.slots, self.random = [self.make(self.bits, self.loss) for _ in range(self.replicas)], Merand48(self.seed)

    def predict(self, idx, val):
        each = [s.predict(idx, val) for s in self.slots]
        if self.kind == "mean":
            return float(np.mean(each))
        counts = Counter(each)
        return min(counts, key=lambda x: (-counts[x], x))

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        for s in self.slots:
            if times := self.random.poisson1():
                s.learn(idx, val, y, weight * times)
        return p

    def rows(self):
        return _stack([s.rows() for s in self.slots], self.bits)


@dataclass
class Signed(Kernel):
    """-1 or 1 by the sign of another learner's prediction."""

    base: Kernel

    def predict(self, idx, val):
        return 1.0 if self.base.predict(idx, val) > 0 else -1.0

    def learn(self, idx, val, y, weight):
        return 1.0 if self.base.learn(idx, val, y, weight) > 0 else -1.0

    def rows(self):
        return self.base.rows()


@dataclass
class Tournament(OneAgainstAll):
    """Error-correcting tournament: pairs of classes meet, a second bracket lets each lose once."""

    errors: int = 1

    def __post_init__(self):
        self.matches: dict[tuple[int, int, int], Kernel] = {}

    def _meet(self, bracket, a, b) -> Kernel:
        return self.matches.setdefault((bracket, a, b), self.make(self.bits, "logistic"))

    def _play(self, idx, val, truth=None, weight=1.0):
        losers, field_, winner = [], list(range(1, self.classes + 1)), 0
        for bracket in range(self.errors + 1):
            entrants, out = field_, []
            while len(entrants) > 1:
                rest = []
                for a, b in zip(entrants[::2], [*entrants[1::2], None], strict=False):
                    if b is None:
                        rest.append(a)
                        continue
                    m = self._meet(bracket, a, b)
                    if truth in (a, b):
                        m.learn(idx, val, 1.0 if truth == a else -1.0, weight)
                    first = m.predict(idx, val) > 0
                    rest.append(a if first else b)
                    out.append(b if first else a)
                entrants = rest
            losers.append(entrants[0])
            field_ = out or entrants
        winner = losers[0]
        for rival in losers[1:]:
            if rival != winner:
                a, b = sorted((winner, rival))
                m = self._meet(self.errors + 1, a, b)
                if truth in (a, b):
                    m.learn(idx, val, 1.0 if truth == a else -1.0, weight)
                winner = a if m.predict(idx, val) > 0 else b
        return winner

    def predict(self, idx, val):
        return float(self._play(idx, val))

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        self._play(idx, val, int(y), weight)
        return p

    def rows(self):
        parts = [m.rows() for _, m in sorted(self.matches.items())]
        return _stack(parts, self.bits)


def _stack(parts, bits):
    none = np.zeros(0)
    if not parts:
        return none.astype(np.int64), none, none
    return np.concatenate([a + (k << bits) for k, (a, _, _) in enumerate(parts)]), np.concatenate([w for _, w, _ in parts]), np.concatenate([x for _, _, x in parts])


@dataclass
class Boosting(Kernel):
    """Online boosting: by majority with an edge ``gamma``, or logistic with learnt mixing weights."""

    learners: int = 4
    kind: str = "BBM"
    gamma: float = 0.1
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.slots = [self.make(self.bits, "logistic") for _ in range(self.learners)]
        self.alpha, self.t = np.zeros(self.learners), 0

    def _votes(self, idx, val):
        return np.array([1.0 if s.predict(idx, val) > 0 else -1.0 for s in self.slots])

    def predict(self, idx, val):
        votes = self._votes(idx, val)
        total = float((self.alpha if self.kind == "logistic" else np.ones(self.learners)) @ votes)
        return 1.0 if total > 0 else -1.0

    def learn(self, idx, val, y, weight):
        p, margin = self.predict(idx, val), 0.0
        self.t += 1
        for i, s in enumerate(self.slots):
            z = y * (1.0 if s.predict(idx, val) > 0 else -1.0)
            if self.kind == "logistic":
                w = 1 / (1 + math.exp(min(margin, 500)))
                margin += z * self.alpha[i]
                self.alpha[i] = min(max(self.alpha[i] + 4 / math.sqrt(self.t) * z / (1 + math.exp(min(margin, 500))), -2), 2)
            else:
                left = self.learners - i - 1
                k = math.floor((self.learners - i - margin) / 2)
                w = math.comb(left, k) * (0.5 + self.gamma) ** k * (0.5 - self.gamma) ** (left - k) if 0 <= k <= left else 0.0
                margin += z
            if w > 0:
                s.learn(idx, val, y, weight * w)
        return p

    def rows(self):
        return _stack([s.rows() for s in self.slots], self.bits)


@dataclass
class LabelTree(Kernel):
    """Probabilistic label tree: a binary problem at each node of a complete tree; a label's
    probability is the product along its path. ``y`` is the label's number from 0."""

    labels: int = 2
    arity: int = 2
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.internal = (self.labels - 1 + self.arity - 2) // (self.arity - 1) if self.labels > 1 else 0
        self.nodes: dict[int, Kernel] = {}

    def _node(self, n):
        return self.nodes.setdefault(n, self.make(self.bits, "logistic"))

    def _p(self, n, idx, val):
        return 1 / (1 + math.exp(-max(min(self._node(n).predict(idx, val), 500), -500)))

    def top(self, idx, val, k=1):
        """Best-first search: (probability, label) of the k most likely labels."""
        import heapq

        heap, out = [(-self._p(0, idx, val), 0)], []
        while heap and len(out) < k:
            p, n = heapq.heappop(heap)
            if n >= self.internal:
                out.append((-p, n - self.internal))
                continue
            for child in range(self.arity * n + 1, self.arity * n + self.arity + 1):
                if child < self.internal + self.labels:
                    heapq.heappush(heap, (p * self._p(child, idx, val), child))
        return out

    def predict(self, idx, val):
        return float(self.top(idx, val)[0][1])

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        positive, n = set(), int(y) + self.internal
        while True:
            positive.add(n)
            if n == 0:
                break
            n = (n - 1) // self.arity
        negative = {c for n in positive if n < self.internal for c in range(self.arity * n + 1, self.arity * n + self.arity + 1) if c not in positive and c < self.internal + self.labels}
        for n in sorted(positive):
            self._node(n).learn(idx, val, 1.0, weight)
        for n in sorted(negative):
            self._node(n).learn(idx, val, -1.0, weight)
        return p

    def rows(self):
        return _stack([m.rows() for _, m in sorted(self.nodes.items())], self.bits)


@dataclass
class LogTree(Kernel):
    """Log-time multiclass: nodes split classes by comparing a class's mean score with the node's."""

    classes: int = 2
    swap: float = 4.0
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.nodes = [{"router": None, "counts": Counter(), "sum": 0.0, "n": 0, "by": {}, "kids": None}]
        self.most = max(2 * self.classes - 1, 1)

    def _leaf(self, idx, val, truth=None, weight=1.0):
        at = 0
        while True:
            node = self.nodes[at]
            if truth is not None:
                node["counts"][truth] += 1
            if node["kids"] is None:
                if truth is None or len(node["counts"]) < 2 or len(self.nodes) + 2 > self.most:
                    return node
                node["kids"], node["router"] = (len(self.nodes), len(self.nodes) + 1), self.make(self.bits, "logistic")
                self.nodes += [{"router": None, "counts": Counter(), "sum": 0.0, "n": 0, "by": {}, "kids": None} for _ in range(2)]
            score = node["router"].predict(idx, val)
            if truth is not None:
                own = node["by"].setdefault(truth, [0.0, 0])
                mean = node["sum"] / node["n"] if node["n"] else 0.0
                side = 1.0 if (own[0] / own[1] if own[1] else score) > mean else -1.0
                node["router"].learn(idx, val, side, weight)
                score = node["router"].predict(idx, val)
                own[0], own[1] = own[0] + score, own[1] + 1
                node["sum"], node["n"] = node["sum"] + score, node["n"] + 1
            at = node["kids"][1 if score > 0 else 0]

    def predict(self, idx, val):
        counts = self._leaf(idx, val)["counts"]
        return float(min(counts, key=lambda c: (-counts[c], c))) if counts else 1.0

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        self._leaf(idx, val, int(y), weight)
        return p

    def rows(self):
        return _stack([n["router"].rows() for n in self.nodes if n["router"]], self.bits)


@dataclass
class MemoryTree(Kernel):
    """Nearest-memory prediction: routers send an example to a leaf, whose most similar memory gives
    its label. With a ``capacity`` only so many memories stay; the least recently used goes first."""

    leaf: int = 16
    capacity: int = 0
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.root = {"memories": OrderedDict(), "router": None, "kids": None}
        self.order: OrderedDict = OrderedDict()
        self.n = 0

    def _down(self, idx, val):
        node = self.root
        while node["kids"]:
            node = node["kids"][1 if node["router"].predict(idx, val) > 0 else 0]
        return node

    @staticmethod
    def _near(idx, val, memory):
        mine = dict(zip(idx.tolist(), val.tolist(), strict=True))
        dot = sum(mine.get(i, 0.0) * v for i, v in zip(memory[0].tolist(), memory[1].tolist(), strict=True))
        return dot / max(math.sqrt(float(val @ val) * float(memory[1] @ memory[1])), 1e-12)

    def predict(self, idx, val):
        memories = self._down(idx, val)["memories"]
        if not memories:
            return 0.0
        best = max(memories, key=lambda k: (self._near(idx, val, memories[k]), -k))
        self.order.move_to_end(best)
        return float(memories[best][2])

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        node = self._down(idx, val)
        self.n += 1
        node["memories"][self.n] = (idx, val, y)
        self.order[self.n] = node
        if self.capacity and len(self.order) > self.capacity:
            old, _ = self.order.popitem(last=False)
            self._forget(self.root, old)
        if len(node["memories"]) > self.leaf:
            self._split(node)
        return p

    def _forget(self, node, key):
        if node["kids"]:
            for kid in node["kids"]:
                self._forget(kid, key)
        node["memories"].pop(key, None)

    def _split(self, node):
        """A router along the direction in which a leaf's memories differ most (one power iteration)."""
        keys = list(node["memories"])
        a, b = node["memories"][keys[0]], min((node["memories"][k] for k in keys[1:]), key=lambda m: self._near(node["memories"][keys[0]][0], node["memories"][keys[0]][1], m))
        node["router"] = self.make(self.bits, "logistic")
        for m in (a, b) * 3:
            node["router"].learn(m[0], m[1], 1.0 if m is a else -1.0, 1.0)
        node["kids"] = tuple({"memories": OrderedDict(), "router": None, "kids": None} for _ in range(2))
        for k in keys:
            m = node["memories"][k]
            node["kids"][1 if node["router"].predict(m[0], m[1]) > 0 else 0]["memories"][k] = m
        node["memories"] = OrderedDict()
        if any(len(kid["memories"]) == len(keys) for kid in node["kids"]):
            halves = [OrderedDict((k, m) for j, (k, m) in enumerate((x, next(kid["memories"][x] for kid in node["kids"] if x in kid["memories"])) for x in keys) if j % 2 == h) for h in (0, 1)]
            for kid, half in zip(node["kids"], halves, strict=True):
                kid["memories"] = half

    def _nodes(self):
        queue = [self.root]
        for node in queue:
            queue += node["kids"] or ()
        return queue

    def rows(self):
        """The routers' weights, node by node from the root."""
        return _stack([n["router"].rows() if n["router"] else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for n in self._nodes()], self.bits)

    def memories(self):
        """(node, indices, values, label) of what is remembered; nodes are numbered as in ``rows``."""
        return [(k, idx, val, y) for k, n in enumerate(self._nodes()) for idx, val, y in n["memories"].values()]


@dataclass
class Active(Kernel):
    """Importance-weighted active learning: a label is asked for with the probability that it could
    still change the sign of the prediction, and weighs the inverse of it."""

    mellowness: float = 8.0
    seed: int = 0
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.base, self.random, self.t, self.asked = self.make(self.bits, "logistic"), Merand48(self.seed), 0.0, 0

    def predict(self, idx, val):
        return self.base.predict(idx, val)

    def query_probability(self, p: float, sensitivity: float) -> float:
        if self.t < 2 or sensitivity <= 0:
            return 1.0
        gap = abs(p) / (sensitivity * self.t)
        room = self.mellowness * math.log(self.t + 1) / self.t
        if gap <= math.sqrt(room) + room:
            return 1.0
        s = (room + math.sqrt(room * room + 4 * gap * gap * room)) / (2 * gap * gap)
        return min(1.0, max(s * s, 1e-4))

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        self.t += weight
        q = self.query_probability(p, self.base.sensitivity(idx, val) if self.t > 1 else 0.0)
        if self.random.uniform() < q:
            self.asked += 1
            self.base.learn(idx, val, y, weight / q)
        return p

    def rows(self):
        return self.base.rows()


@dataclass
class Replay(Kernel):
    """Experience replay: each example takes a random slot of a buffer, and what it drives out is learnt."""

    base: Kernel = field(default_factory=lambda: _base(14))
    size: int = 16
    times: int = 1
    seed: int = 0

    def __post_init__(self):
        self.buffer: list = [None] * self.size
        self.random = Merand48(self.seed)

    def predict(self, idx, val):
        return self.base.predict(idx, val)

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        for k in range(self.times):
            at = int(self.random.uniform() * self.size)
            if self.buffer[at] is not None:
                self.base.learn(*self.buffer[at])
            if k == 0:
                self.buffer[at] = (idx, val, y, weight)
        return p

    def end_pass(self):
        for at, x in enumerate(self.buffer):
            if x is not None:
                self.base.learn(*x)
                self.buffer[at] = None
        self.base.end_pass()

    def rows(self):
        return self.base.rows()


@dataclass
class Baseline(Kernel):
    """A constant learns first, the model what is left."""

    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.constant, self.rest = self.make(1), self.make(self.bits, low=-1e9, high=1e9)
        self.one = (np.zeros(1, np.int64), np.ones(1))

    def predict(self, idx, val):
        return self.constant.predict(*self.one) + self.rest._raw(idx, val)

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        base = self.constant.learn(*self.one, y, weight)
        self.rest.learn(idx, val, y - base, weight)
        return p

    def rows(self):
        return self.rest.rows()


@dataclass
class KernelMachine(Kernel):
    """Kernel support vectors, one coordinate at a time: linear, polynomial or radial similarity."""

    kind: str = "rbf"
    width: float = 1.0
    degree: int = 2
    l2: float = 0.01
    reprocess: int = 1

    def __post_init__(self):
        self.support: list = []  # [indices, values, label, alpha, score]

    def _k(self, a, b):
        mine = dict(zip(a[0].tolist(), a[1].tolist(), strict=True))
        dot = sum(mine.get(i, 0.0) * v for i, v in zip(b[0].tolist(), b[1].tolist(), strict=True))
        if self.kind == "rbf":
            return math.exp(-self.width * (float(a[1] @ a[1]) + float(b[1] @ b[1]) - 2 * dot))
        return (1 + dot) ** self.degree if self.kind == "poly" else dot

    def predict(self, idx, val):
        return sum(s[3] * s[2] * self._k(s, (idx, val)) for s in self.support) / self.l2 if self.support else 0.0

    def _step(self, s, most):
        """One coordinate to its optimum inside [0, most], by 1 at most; all scores follow."""
        want = s[3] + (1 - s[2] * s[4]) / max(self._k(s, s) / self.l2, 1e-12)
        new = min(max(want, s[3] - 1, 0.0), s[3] + 1, most)
        if move := (new - s[3]) * s[2] / self.l2:
            for other in self.support:
                other[4] += move * self._k(s, other)
        s[3] = new

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        if y * p < 1:
            new = [idx, val, y, 0.0, p]
            self.support.append(new)
            self._step(new, weight)
            for _ in range(self.reprocess):
                self._step(max(self.support, key=lambda s: abs(1 - s[2] * s[4])), weight)
            self.support = [s for s in self.support if s[3] > 1e-6]
        return p

    def rows(self):
        at = np.arange(len(self.support))
        return at, np.array([s[3] * s[2] for s in self.support]), np.zeros(len(at))


@dataclass
class OjaNewton(Kernel):
    """Online Newton with a sketch of the gradients' leading directions by Oja's rule."""

    size: int = 4
    rate: float = 1.0
    alpha: float = 1.0
    loss: str = "squared"
    bits: int = 10

    def __post_init__(self):
        n = 1 << self.bits
        self.w, self.d = np.zeros(n), np.ones(self.size)
        self.z = np.linalg.qr(np.random.default_rng(0).normal(size=(n, self.size)))[0]
        self.t = 0

    def predict(self, idx, val):
        return float(self.w[idx] @ val)

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        self.t += 1
        g = loss_slope(self.loss, p, y) * weight * val
        along = self.z[idx].T @ g
        # (alpha I + Z D Z')^-1 g by the identity for low-rank updates.
        step = np.zeros_like(self.w)
        step[idx] = g / self.alpha
        step -= self.z @ (along * self.d / (self.alpha * (self.alpha + self.d)))
        self.w -= self.rate * step / max(math.sqrt(self.t), 1)
        rate = 1 / self.t
        grown = self.z * (1 - rate)
        grown[idx] += rate * np.outer(g, along)
        self.z, r = np.linalg.qr(grown)
        self.d = (1 - rate) * self.d + rate * along * along * self.t
        return p

    def rows(self):
        at = np.flatnonzero(self.w)
        return at, self.w[at], np.zeros(len(at))


@dataclass
class CatsTree(Kernel):
    """Continuous actions by a binary tree over bins: each node learns which side costs less.

    ``y`` is (action, cost, density) packed in the three last values of the example by ``pack``."""

    bins: int = 8
    low: float = 0.0
    high: float = 1.0
    bandwidth: int = 1
    bits: int = 12
    make: Maker = _base

    def __post_init__(self):
        self.depth = math.ceil(math.log2(self.bins))
        self.nodes: dict[int, Kernel] = {}

    def _node(self, n):
        return self.nodes.setdefault(n, self.make(self.bits, "logistic"))

    def bin_of(self, idx, val):
        n = 0
        for _ in range(self.depth):
            n = 2 * n + (2 if self._node(n).predict(idx, val) > 0 else 1)
        return min(n - (1 << self.depth) + 1, self.bins - 1)

    def predict(self, idx, val):
        unit = (self.high - self.low) / self.bins
        return self.low + (self.bin_of(idx, val) + 0.5) * unit

    def learn_logged(self, idx, val, action, cost, density, weight=1.0):
        p = self.predict(idx, val)
        unit = (self.high - self.low) / self.bins
        at = min(max(int((action - self.low) / unit), 0), self.bins - 1)
        first, last = max(at - self.bandwidth, 0), min(at + self.bandwidth, self.bins - 1)
        each = cost / max(density * unit * (last - first + 1), 1e-6)
        costs = {k + (1 << self.depth) - 1: each for k in range(first, last + 1)}
        while max(costs) > 0:
            up: dict[int, float] = {}
            for parent in {(n - 1) // 2 for n in costs}:
                a, b = costs.get(2 * parent + 1, 0.0), costs.get(2 * parent + 2, 0.0)
                if a != b:
                    self._node(parent).learn(idx, val, 1.0 if b < a else -1.0, weight * abs(a - b))
                up[parent] = b if self._node(parent).predict(idx, val) > 0 else a
            costs = up
            if set(costs) == {0}:
                break
        return p

    def learn(self, idx, val, y, weight):
        return self.learn_logged(idx, val, y, -weight, 1.0)

    def rows(self):
        return _stack([m.rows() for _, m in sorted(self.nodes.items())], self.bits)


@dataclass
class ZerothOrder(Kernel):
    """Continuous action from a linear policy, moved by cost over distance from the logged action."""

    rate: float = 0.1
    radius: float = 0.1
    low: float = -1e9
    high: float = 1e9
    bits: int = 12

    def __post_init__(self):
        self.w = np.zeros(1 << self.bits)

    def predict(self, idx, val):
        return min(max(float(self.w[idx] @ val), self.low), self.high)

    def learn_logged(self, idx, val, action, cost, weight=1.0):
        p = self.predict(idx, val)
        gap = action - p
        gap = math.copysign(max(abs(gap), 1e-6), gap)
        self.w[idx] -= self.rate * weight * cost / gap * val
        return p

    def learn(self, idx, val, y, weight):
        return self.learn_logged(idx, val, y, weight)

    def density(self, idx, val):
        """Two spikes, a radius to each side of the policy's action."""
        c = self.predict(idx, val)
        return [(c - self.radius, 0.5), (c + self.radius, 0.5)]

    def rows(self):
        at = np.flatnonzero(self.w)
        return at, self.w[at], np.zeros(len(at))


class Sequences:
    """Learning to search for sequence labels: a policy labels left to right with its last labels as
    features; at every step the costs of all labels, rolled out by the reference or the policy, are
    learnt as a cost-sensitive problem."""

    def __init__(self, labels: int, history: int = 1, rollout: str = "oracle", bits: int = 16):
        self.labels, self.history, self.rollout, self.bits = labels, history, rollout, bits
        self.slots = [_base(bits) for _ in range(labels)]

    def _with_history(self, idx, val, before):
        extra = [((k + 1) * 7919 + b * 104729) % (1 << self.bits) for k, b in enumerate(before[-self.history :][::-1])]
        return np.concatenate([idx, np.array(extra, np.int64)]), np.concatenate([val, np.ones(len(extra))])

    def step(self, idx, val, before, allowed=None):
        x = self._with_history(idx, val, before)
        return min(allowed or range(self.labels), key=lambda k: (self.slots[k].predict(*x), k))

    def decode(self, steps, allowed=None):
        out: list[int] = []
        for idx, val in steps:
            out.append(self.step(idx, val, out, allowed(out) if allowed else None))
        return out

    def learn(self, steps, truth):
        rolled = self.decode(steps)
        for t, (idx, val) in enumerate(steps):
            before = rolled[:t]
            for k in range(self.labels):
                cost = float(k != truth[t])
                if self.rollout == "policy" and t + 1 < len(steps):
                    cost += float(self.step(*steps[t + 1], [*before, k]) != truth[t + 1])
                self.slots[k].learn(*self._with_history(idx, val, before), cost, 1.0)
        return rolled


def bio_allowed(labels: int):
    """Spans as labels 0 outside, odd begin, even inside: inside follows only its own begin or inside."""

    def allowed(before):
        last = before[-1] if before else 0
        return [k for k in range(labels) if k == 0 or k % 2 == 1 or last in (k, k - 1)]

    return allowed


def shift_reduce(heads_score, n: int) -> list[int]:
    """Arc-hybrid dependency parse: shift, left arc or right arc by the best score; heads of words 1..n."""
    stack, at, heads = [0], 1, [0] * (n + 1)
    while at <= n or len(stack) > 1:
        actions = []
        if at <= n:
            actions.append("shift")
        if len(stack) > 1 and at <= n:
            actions.append("left")
        if len(stack) > 1 and (len(stack) > 2 or at > n):
            actions.append("right")
        action = max(actions, key=lambda a: (heads_score(a, stack, at), -["shift", "left", "right"].index(a)))
        if action == "shift":
            stack.append(at)
            at += 1
        elif action == "left":
            heads[stack.pop()] = at
        else:
            top = stack.pop()
            heads[top] = stack[-1]
    return heads[1:]


@dataclass
class Policy:
    """Contextual bandit over actions with features: a cost regressor, an estimator for the logged
    event, and an exploration distribution; ccb and slates run it slot by slot."""

    estimator: str = "mtr"
    explore: str = "epsilon"
    epsilon: float = 0.05
    gamma: float = 10.0
    temperature: float = 1.0
    bags: int = 4
    psi: float = 1.0
    clip: float = 0.0
    seed: int = 0
    bits: int = 16
    make: Maker = _base

    def __post_init__(self):
        self.models = [self.make(self.bits, low=-1e9, high=1e9) for _ in range(self.bags if self.explore in ("bag", "cover") else 1)]
        self.reward = self.make(self.bits, low=-1e9, high=1e9)
        self.events, self.actions, self.random = 0, 0, Merand48(self.seed)

    def costs(self, actions, model=0):
        return np.array([self.models[model]._raw(i, v) for i, v in actions])

    def distribution(self, actions):
        k, costs = len(actions), self.costs(actions)
        if self.explore == "softmax":
            e = np.exp(-self.temperature * (costs - costs.min()))
            return e / e.sum()
        if self.explore == "squarecb":
            gamma = self.gamma * max(self.events, 1) ** 0.5
            p, best = 1 / (k + gamma * (costs - costs.min())), int(costs.argmin())
            p[best] = 0
            p[best] = 1 - p.sum()
            return p
        if self.explore == "bag":
            votes = np.bincount([int(self.costs(actions, m).argmin()) for m in range(len(self.models))], minlength=k) / len(self.models)
            return (1 - self.epsilon) * votes + self.epsilon / k
        if self.explore == "cover":
            return self._cover(actions)
        if self.explore == "first":
            return np.full(k, 1 / k) if self.events < self.gamma else np.eye(k)[int(costs.argmin())]
        ties = costs == costs.min()
        return self.epsilon / k + (1 - self.epsilon) * ties / ties.sum()

    def _cover(self, actions, targets=None):
        """Online cover: the policies' votes, each action at least ``least``. With ``targets`` every
        policy but the first first learns them less psi over the coverage of those before it."""
        k = len(actions)
        least = min(self.epsilon / k, self.epsilon / math.sqrt(max(self.events - (targets is not None), 1) * k))
        votes, share = np.zeros(k), 1 / len(self.models)
        norm = least * k + share - least
        for m, model in enumerate(self.models):
            if targets is not None and m:
                lowered = targets - self.psi * least * norm / np.maximum(votes, least)
                for x, target in zip(actions, lowered, strict=True):
                    model.learn(*x, target, 1.0)
            costs = self.costs(actions, m)
            ties = np.flatnonzero(costs == costs.min())
            for j in ties:
                if m:
                    norm += max(0.0, share / len(ties) - max(0.0, least - votes[j]))
                votes[j] += share / len(ties)
        # The actions below the least are raised to it, the others share what is left.
        low = votes <= least
        votes[low] = least
        votes[~low] *= (1 - least * low.sum()) / votes[~low].sum()
        return votes

    def _targets(self, actions, chosen, cost, p, estimator):
        """The estimated cost of every action, from the logged one."""
        guess = np.array([self.reward._raw(i, v) for i, v in actions]) if estimator in ("dr", "dm") else np.zeros(len(actions))
        if estimator != "dm":
            guess[chosen] += (cost - guess[chosen]) / p
        return guess

    @staticmethod
    def _softmax_step(model, actions, chosen, cost, p):
        """Raises the chosen action's cost score and lowers the others' (the other way for a negative
        cost), each by as much as the softmax of the scores says it takes part."""
        scores = np.array([model._raw(i, v) for i, v in actions])
        share = np.exp(scores.min() - scores)
        share /= share.sum()
        sign = -1.0 if cost < 0 else 1.0
        weight = abs(cost) / p * share[chosen]
        for j, x in enumerate(actions):
            own = weight * (1 - share[j] if j == chosen else share[j])
            if own > 1e-15:
                model.learn(*x, min(max(scores[j] + (sign if j == chosen else -sign), -100.0), 100.0), own)

    def learn(self, actions, chosen, cost, p):
        """Learns a logged event; returns the distribution it had before. With mtr, cover's policies
        after the first learn from dr's estimates."""
        before = self.distribution(actions)
        p = max(p if p > 0 else 1e-3, self.clip)
        self.events += 1
        self.actions += len(actions)
        estimator = "dr" if self.explore == "cover" and self.estimator == "mtr" else self.estimator
        for m, model in enumerate(self.models[:1] if self.explore == "cover" else self.models):
            times = self.random.poisson1() if self.explore == "bag" and m else 1
            for _ in range(times):
                if self.estimator == "mtr":
                    model.learn(*actions[chosen], cost, 1 / p * self.events / self.actions)
                    continue
                if self.estimator == "sm":
                    self._softmax_step(model, actions, chosen, cost, p)
                    continue
                for x, target in zip(actions, self._targets(actions, chosen, cost, p, estimator), strict=True):
                    model.learn(*x, target, 1.0)
        if self.explore == "cover":
            self._cover(actions, self._targets(actions, chosen, cost, p, estimator))
        if estimator in ("dr", "dm"):
            self.reward.learn(*actions[chosen], cost, 1.0)
        return before

    def slots(self, actions, slots, pools=None):
        """A distribution over what is left for each slot in turn; the likeliest of a slot is then gone.
        With ``pools`` (slates) each slot has actions of its own."""
        left, out = list(range(len(actions))), []
        for s, (si, sv) in enumerate(slots):
            mine = pools[s] if pools else left
            joined = [(np.concatenate([actions[a][0], si]), np.concatenate([actions[a][1], sv])) for a in mine]
            p = self.distribution(joined)
            best = mine[int(np.argmax(p))]
            out.append((mine, p, best))
            if not pools:
                left = [a for a in left if a != best]
        return out


class ChampionRace:
    """Configurations that race on a stream: a challenger takes over when the lower confidence bound
    of its reward passes the champion's upper one (automl, epsilon decay)."""

    def __init__(self, policies: list, alpha: float = 0.05, least: int = 50):
        self.policies, self.alpha, self.least, self.champion = policies, alpha, least, 0
        self.stats = [[0.0, 0.0, 0.0] for _ in policies]

    def bounds(self, k):
        n, total, squares = self.stats[k]
        if n < 2:
            return -math.inf, math.inf
        mean, var = total / n, max(squares / n - (total / n) ** 2, 0.0)
        # Holds at all times: the deviation grows with the logarithm of the time.
        width = math.sqrt(2 * (var + 1 / n) * (math.log(2 / self.alpha) + math.log(math.log(max(n, 3)) + 1)) / n)
        return mean - width, mean + width

    def learn(self, actions, chosen, cost, p):
        for k, policy in enumerate(self.policies):
            ratio = policy.learn(actions, chosen, cost, p)[chosen] / max(p, 1e-3)
            s = self.stats[k]
            s[0], s[1], s[2] = s[0] + 1, s[1] - ratio * cost, s[2] + (ratio * cost) ** 2
        top = self.bounds(self.champion)[1]
        for k in range(len(self.policies)):
            if k != self.champion and self.stats[k][0] >= self.least and self.bounds(k)[0] > top:
                self.champion = k
                break
        return self.champion


def spanner(vectors: np.ndarray, most: int, c: float = 2.0) -> list[int]:
    """C-approximate barycentric spanner: rows whose volume no exchange multiplies by more than ``c``."""
    u, s, _ = np.linalg.svd(vectors, full_matrices=False)
    keep = max(1, min(most, int((s > 1e-8).sum())))
    x = u[:, :keep] * s[:keep]
    basis, chosen = np.eye(keep), [-1] * keep

    def gains(j):
        rest = np.delete(basis, j, 0)
        normal = np.linalg.svd(rest, full_matrices=True)[2][-1] if keep > 1 else np.ones(1)
        return np.abs(x @ normal), abs(float(basis[j] @ normal))

    for j in range(keep):
        g, _ = gains(j)
        chosen[j] = int(g.argmax())
        basis[j] = x[chosen[j]]
    for _ in range(keep * 10):
        for j in range(keep):
            g, own = gains(j)
            if g.max() > c * max(own, 1e-12):
                chosen[j] = int(g.argmax())
                basis[j] = x[chosen[j]]
                break
        else:
            break
    return sorted(set(chosen))


def lda(docs: list[tuple[np.ndarray, np.ndarray]], topics: int, vocabulary: int, alpha: float = 0.1, rho: float = 0.1, total_docs: float | None = None, batch: int = 32, rate: float = 0.7, passes: int = 1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Online variational topics: (topics, words) parameters and each document's topic weights."""
    rng = np.random.default_rng(seed)
    lam = rng.gamma(100.0, 0.01, (topics, vocabulary))
    total_docs, gammas, t = total_docs or len(docs), np.zeros((len(docs), topics)), 0
    for _ in range(passes):
        for a in range(0, len(docs), batch):
            t += 1
            beta = np.exp(_digamma(lam) - _digamma(lam.sum(1, keepdims=True)))
            stats = np.zeros_like(lam)
            for d in range(a, min(a + batch, len(docs))):
                ids, counts = docs[d]
                g = np.ones(topics)
                for _ in range(50):
                    theta = np.exp(_digamma(g) - _digamma(g.sum()))
                    phi = theta[:, None] * beta[:, ids] + 1e-100
                    new = alpha + (phi / phi.sum(0) * counts).sum(1)
                    done, g = np.abs(new - g).mean() < 1e-3, new
                    if done:
                        break
                gammas[d] = g
                stats[:, ids] += phi / phi.sum(0) * counts
            eta = (t + 1) ** -rate
            lam = (1 - eta) * lam + eta * (rho + total_docs / min(batch, len(docs) - a) * stats)
    return lam, gammas / gammas.sum(1, keepdims=True)


def _digamma(x):
    """By recurrence up to 6, then the asymptotic series."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out -= np.where(small, 1 / np.maximum(x, 1e-12), 0)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))
