"""Log-time learners: a tree with a bound on recall, and a bounded tree of memories split along their
leading direction."""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from dataclasses import dataclass, field

import numpy as np

from .composed import Maker, _base, _stack
from .online import Kernel


@dataclass
class _Node:
    """Counts of labels that reached the node, its router, and its children's places."""

    counts: Counter = field(default_factory=Counter)
    n: float = 0.0
    depth: int = 0
    router: Kernel | None = None
    kids: tuple[int, int] | None = None


def _entropy(counts: Counter, n: float) -> float:
    return -sum(c / n * math.log2(c / n) for c in counts.values() if c) if n else 0.0


@dataclass
class RecallTree(Kernel):
    """Log-time multiclass with a recall bound: an example goes down while the chance that its class
    is among the child's most frequent ones is likely better than at the node; the classes that are
    most frequent where it stops compete one against the others.

    A node's router learns the side on which the label adds less entropy. A node gets children once
    it has as many examples as classes that it may offer."""

    classes: int = 2
    candidates: int = 0
    most_depth: int = 0
    confidence: float = 1.0
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.candidates = self.candidates or max(1, min(self.classes, 4 * math.ceil(math.log2(max(self.classes, 2)))))
        self.most_depth = self.most_depth or math.ceil(math.log2(max(self.classes, 2)))
        self.nodes = [_Node()]
        self.scorers = [self.make(self.bits, "logistic") for _ in range(self.classes)]

    def offered(self, node: _Node) -> list[int]:
        return [c for c, _ in sorted(node.counts.items(), key=lambda x: (-x[1], x[0]))[: self.candidates]]

    def recall(self, node: _Node) -> float:
        """Lower end for the share of examples whose class is offered."""
        if node.n <= 0:
            return 0.0
        share = sum(sorted(node.counts.values(), reverse=True)[: self.candidates]) / node.n
        deviation = math.sqrt(share * (1 - share) / node.n)
        return share - math.sqrt(self.confidence) * deviation - 15 * self.confidence / (math.sqrt(18) * node.n)

    def _way(self, idx, val):
        at, path = 0, [0]
        while kids := self.nodes[at].kids:
            nxt = kids[1 if self.nodes[at].router.predict(idx, val) > 0 else 0]
            if self.recall(self.nodes[at]) > self.recall(self.nodes[nxt]):
                break
            at = nxt
            path.append(at)
        return path

    def predict(self, idx, val):
        among = self.offered(self.nodes[self._way(idx, val)[-1]])
        return float(min(among, key=lambda c: (-self.scorers[c - 1].predict(idx, val), c))) if among else 1.0

    def _added(self, node: _Node, label: int, weight: float) -> float:
        grown = node.counts + Counter({label: weight})
        return (node.n + weight) * _entropy(grown, node.n + weight) - node.n * _entropy(node.counts, node.n)

    def learn(self, idx, val, y, weight):
        p, label, at = self.predict(idx, val), int(y), 0
        while True:
            node = self.nodes[at]
            node.counts[label] += weight
            node.n += weight
            if node.kids is None:
                if node.depth >= self.most_depth or len(node.counts) < 2 or node.n < self.candidates:
                    break
                node.kids, node.router = (len(self.nodes), len(self.nodes) + 1), self.make(self.bits, "logistic")
                self.nodes += [_Node(depth=node.depth + 1), _Node(depth=node.depth + 1)]
            left, right = (self._added(self.nodes[k], label, weight) for k in node.kids)
            if left != right:
                node.router.learn(idx, val, 1.0 if right < left else -1.0, weight * abs(left - right))
            at = node.kids[1 if node.router.predict(idx, val) > 0 else 0]
        among = self.offered(self.nodes[self._way(idx, val)[-1]])
        if label in among:
            for c in among:
                self.scorers[c - 1].learn(idx, val, 1.0 if c == label else -1.0, weight)
        return p

    def rows(self):
        none = np.zeros(0)
        routers = [n.router.rows() if n.router else (none.astype(np.int64), none, none) for n in self.nodes]
        return _stack([*routers, *(s.rows() for s in self.scorers)], self.bits)


@dataclass
class EigenMemoryTree(Kernel):
    """Nearest memories in a tree whose nodes cut at the median of their memories' projections on the
    leading direction. At most ``capacity`` memories: the least recently used one goes first. How
    near two examples are is learnt: weights on the distances by feature, moved so that memories of
    the same label come nearer."""

    leaf: int = 100
    capacity: int = 0
    rate: float = 0.1
    bits: int = 14

    def __post_init__(self):
        self.root = {"memories": [], "router": None, "kids": None}
        self.used: OrderedDict[int, tuple] = OrderedDict()  # number -> (node, indices, values, label)
        self.scale, self.n = np.ones(1 << self.bits), 0

    def _down(self, idx, val):
        node = self.root
        while node["kids"]:
            direction, cut = node["router"]
            node = node["kids"][int(sum(direction.get(i, 0.0) * v for i, v in zip(idx.tolist(), val.tolist(), strict=True)) > cut)]
        return node

    def _distance(self, idx, val, other) -> tuple[float, dict[int, float]]:
        gap = dict(zip(idx.tolist(), val.tolist(), strict=True))
        for i, v in zip(other[1].tolist(), other[2].tolist(), strict=True):
            gap[i] = gap.get(i, 0.0) - v
        parts = {i: v * v for i, v in gap.items() if v}
        return sum(self.scale[i] * x for i, x in parts.items()), parts

    def _ranked(self, idx, val, node):
        return sorted(((self._distance(idx, val, self.used[k])[0], -k) for k in node["memories"]))

    def predict(self, idx, val):
        near = self._ranked(idx, val, self._down(idx, val))
        if not near:
            return 0.0
        best = -near[0][1]
        self.used.move_to_end(best)
        return float(self.used[best][3])

    def learn(self, idx, val, y, weight):
        p, node = self.predict(idx, val), self._down(idx, val)
        near = [-k for _, k in self._ranked(idx, val, node)[:2]]
        if len(near) == 2 and (self.used[near[0]][3] == y) != (self.used[near[1]][3] == y):
            right, wrong = near if self.used[near[0]][3] == y else near[::-1]
            for k, sign in ((right, -1), (wrong, 1)):
                for i, x in self._distance(idx, val, self.used[k])[1].items():
                    self.scale[i] = max(self.scale[i] + sign * self.rate * weight * x / 2, 0.0)
        self.n += 1
        self.used[self.n] = (node, idx, val, y)
        node["memories"].append(self.n)
        if self.capacity and len(self.used) > self.capacity:
            old, (home, *_) = self.used.popitem(last=False)
            home["memories"].remove(old)
        if len(node["memories"]) > self.leaf:
            self._split(node)
        return p

    def _split(self, node):
        keys = node["memories"]
        names = sorted({i for k in keys for i in self.used[k][1].tolist()})
        place = {i: j for j, i in enumerate(names)}
        x = np.zeros((len(keys), len(names)))
        for row, k in enumerate(keys):
            for i, v in zip(self.used[k][1].tolist(), self.used[k][2].tolist(), strict=True):
                x[row, place[i]] += v
        direction = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0]
        along = x @ direction
        cut = float(np.median(along))
        sides = along > cut
        if sides.all() or not sides.any():
            return
        node["router"] = ({i: float(direction[j]) for i, j in place.items()}, cut)
        node["kids"] = tuple({"memories": [k for k, s in zip(keys, sides, strict=True) if s == side], "router": None, "kids": None} for side in (False, True))
        for kid in node["kids"]:
            for k in kid["memories"]:
                _, *rest = self.used[k]
                # Assigning to a key that exists keeps its place in the order of use.
                self.used[k] = (kid, *rest)
        node["memories"] = []

    def rows(self):
        at = np.flatnonzero(self.scale != 1)
        return at, self.scale[at], np.zeros(len(at))
