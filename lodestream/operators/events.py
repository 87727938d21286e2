"""Learners of whole events: cost-sensitive classes, actions with features, offset trees, a baseline
action that is challenged. Each is a fold of a group, like the kernels of ``online``."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .composed import Maker, Policy, _base, _stack
from .online import Kernel


@dataclass
class CostSensitive(Kernel):
    """A cost regressor for each class; the class of least cost, the lowest of ties. ``y`` is the
    list of costs; null costs are not learnt."""

    classes: int = 2
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.slots = [self.make(self.bits, low=-1e9, high=1e9) for _ in range(self.classes)]

    def costs(self, idx, val):
        return [s._raw(idx, val) for s in self.slots]

    def predict(self, idx, val):
        return float(np.argmin(self.costs(idx, val)) + 1)

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        for s, cost in zip(self.slots, y, strict=True):
            if cost is not None:
                s.learn(idx, val, cost, weight)
        return p

    def rows(self):
        return _stack([s.rows() for s in self.slots], self.bits)


@dataclass
class ActionCosts:
    """Cost-sensitive learning over actions with features, one scorer for all: by regression on the
    costs, by classification of the cheapest (weights by how much it matters), or by all pairs."""

    kind: str = "regression"
    bits: int = 16
    make: Maker = _base

    def __post_init__(self):
        self.scorer = self.make(self.bits, low=-1e9, high=1e9)

    def scores(self, actions):
        return np.array([self.scorer._raw(i, v) for i, v in actions])

    def ranking(self, actions):
        return np.argsort(self.scores(actions), kind="stable").tolist()

    def probabilities(self, actions):
        """Logistic of each negated score, brought to a total of 1."""
        each = 1 / (1 + np.exp(np.clip(self.scores(actions), -500, 500)))
        return each / each.sum()

    def learn(self, actions, costs):
        """Learns an event; returns the ranking it had before."""
        before, costs = self.ranking(actions), np.asarray(costs, float)
        low, high = costs.min(), costs.max()
        if self.kind == "regression":
            for (i, v), cost in zip(actions, costs, strict=True):
                self.scorer.learn(i, v, cost, 1.0)
        elif self.kind == "classifier":
            for (i, v), cost in zip(actions, costs, strict=True):
                best = cost == low
                weight = (high if best else cost) - low
                if weight > 0:
                    self.scorer.learn(i, v, -1.0 if best else 1.0, weight)
        else:
            values = all_pairs_values(costs)
            for a in range(len(costs)):
                for b in range(a + 1, len(costs)):
                    gap = abs(values[a] - values[b])
                    if gap >= 1e-6:
                        self.scorer.learn(*difference(actions[a], actions[b]), -1.0 if costs[a] < costs[b] else 1.0, gap)
        return before


def all_pairs_values(costs: np.ndarray) -> np.ndarray:
    """Running total, over the sorted costs, of each gap divided by how many are below it."""
    order = np.argsort(costs, kind="stable")
    gaps = np.diff(costs[order]) / np.arange(1, len(costs))
    out = np.empty(len(costs))
    out[order] = np.concatenate([[0.0], np.cumsum(gaps)])
    return out


def difference(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Features of a less those of b; what they share cancels."""
    total: dict[int, float] = {}
    for sign, (idx, val) in ((1.0, a), (-1.0, b)):
        for i, v in zip(idx.tolist(), val.tolist(), strict=True):
            total[i] = total.get(i, 0.0) + sign * v
    keep = {i: v for i, v in total.items() if v}
    return np.array(list(keep), np.int64), np.array(list(keep.values()))


def paired_tree(leaves: int) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]:
    """Least-depth binary tree by pairing neighbours round by round: the children of the inner nodes
    (numbered after the leaves), and for each leaf its (inner node, side) from the bottom up."""
    inner, alive = [], list(range(leaves))
    while len(alive) > 1:
        up = []
        for k in range(0, len(alive) - 1, 2):
            up.append(leaves + len(inner))
            inner.append((alive[k], alive[k + 1]))
        alive = up + alive[2 * len(up) :]
    above = {child: (n, side) for n, pair in enumerate(inner) for side, child in enumerate(pair)}
    paths = []
    for leaf in range(leaves):
        path, at = [], leaf
        while at in above:
            path.append(above[at])
            at = leaves + above[at][0]
        paths.append(path)
    return inner, paths


@dataclass
class OffsetTree:
    """Bandit over many actions as a tree of two-action bandits: a logged event climbs from its
    action's leaf, its weight shrinking by the probability that each node gives to its side."""

    actions: int = 2
    epsilon: float = 0.05
    bits: int = 14
    make: Maker = _base

    def __post_init__(self):
        self.inner, self.paths = paired_tree(self.actions)
        self.sides = [[self.make(self.bits, low=-1e9, high=1e9) for _ in range(2)] for _ in self.inner]

    def _choice(self, node, idx, val):
        costs = [s._raw(idx, val) for s in self.sides[node]]
        best = int(costs[1] < costs[0])
        return [self.epsilon / 2 + (1 - self.epsilon) * (k == best) for k in range(2)]

    def distribution(self, idx, val):
        at = [self._choice(n, idx, val) for n in range(len(self.inner))]
        return np.array([math.prod(at[n][side] for n, side in path) for path in self.paths])

    def learn(self, idx, val, action, cost, p, weight=1.0):
        """Returns the distribution that was there before."""
        before = self.distribution(idx, val)
        for node, side in self.paths[action]:
            for k, s in enumerate(self.sides[node]):
                s.learn(idx, val, cost / p if k == side else 0.0, weight)
            weight *= self._choice(node, idx, val)[side]
        return before


class BaselineChallenger:
    """A bandit policy beside a baseline action (the first): while the lower bound of the baseline's
    reward is above the policy's mean, both with fading weights, the baseline takes the policy's place."""

    def __init__(self, policy: Policy, lower_bound, tau: float = 0.999):
        self.policy, self.lower_bound, self.tau = policy, lower_bound, tau
        self.total, self.n = 0.0, 0.0
        self.stats = dict.fromkeys(("n", "w", "ww", "wr", "wwr", "wwrr"), 0.0)

    def learn(self, actions, chosen, cost, p):
        """Returns (the action played, mean of the policy, weighted count) after the event."""
        best = int(np.argmax(self.policy.distribution(actions)))
        reward = -cost
        for name, w in (("policy", float(chosen == best) / p), ("baseline", float(chosen == 0) / p)):
            if name == "policy":
                self.total, self.n = self.tau * self.total + w * reward, self.tau * self.n + w
            else:
                parts = {"n": 1.0, "w": w, "ww": w * w, "wr": w * reward, "wwr": w * w * reward, "wwrr": (w * reward) ** 2}
                self.stats = {k: self.tau * v + parts[k] for k, v in self.stats.items()}
        self.policy.learn(actions, chosen, cost, p)
        mean = self.total / self.n if self.n else 0.0
        return (0 if self.lower_bound(self.stats) > mean else best), mean, self.n


def learn_slots(policy: Policy, actions, slots, outcomes, pools=None):
    """(slot, best action, distribution) of an event's slots, each before it is learnt. What the log took
    for a slot is gone for the next ones; with ``pools`` (slates) each slot has actions of its own and
    the event's one cost. A null outcome is not learnt."""
    left, out = list(range(len(actions))), []
    for s, ((si, sv), outcome) in enumerate(zip(slots, outcomes, strict=True)):
        mine = pools[s] if pools else list(left)
        joined = [(np.concatenate([actions[a][0], si]), np.concatenate([actions[a][1], sv])) for a in mine]
        if outcome is None or outcome["action"] not in mine:
            pmf = policy.distribution(joined)
            taken = mine[int(np.argmax(pmf))]
        else:
            taken = outcome["action"]
            pmf = policy.learn(joined, mine.index(taken), outcome["cost"], outcome["p"])
        out.append((s, mine[int(np.argmax(pmf))], pmf))
        if not pools:
            left.remove(taken)
    return out


class Score:
    """Fading-free sums of importance-weighted rewards with bounds that hold at all times."""

    def __init__(self, alpha: float = 0.05):
        self.alpha, self.n, self.total, self.squares = alpha, 0, 0.0, 0.0

    def add(self, ratio: float, cost: float) -> None:
        self.n, self.total, self.squares = self.n + 1, self.total - ratio * cost, self.squares + (ratio * cost) ** 2

    def bounds(self) -> tuple[float, float]:
        if self.n < 2:
            return -math.inf, math.inf
        mean = self.total / self.n
        var = max(self.squares / self.n - mean * mean, 0.0)
        # The deviation grows with the logarithm of the time, so that looking at every event is allowed.
        width = math.sqrt(2 * (var + 1 / self.n) * (math.log(2 / self.alpha) + math.log(math.log(max(self.n, 3)) + 1)) / self.n)
        return mean - width, mean + width


class InteractionSearch:
    """Which interactions a policy should have: a champion set of namespace pairs, and challengers that
    differ from it by one pair. Each challenger runs for a lease of events and is then exchanged for
    the next in the queue, its next lease being twice as long; one whose lower bound passes the
    champion's upper bound becomes the champion, and the queue is made anew around it."""

    def __init__(self, make: Callable[[], Policy], spaces: list[str], challengers: int = 3, lease: int = 100, alpha: float = 0.05, bits: int = 16):
        self.make, self.spaces, self.alpha, self.first_lease, self.mask = make, sorted(spaces), alpha, lease, (1 << bits) - 1
        self.many = challengers
        self._crown(frozenset(), make(), Score(alpha))

    def _crown(self, pairs, policy, score) -> None:
        self.champion = pairs
        self.live = {pairs: [policy, score, math.inf]}
        every = [(a, b) for i, a in enumerate(self.spaces) for b in self.spaces[i:]]
        self.queue = sorted((pairs ^ {x} for x in every), key=lambda c: (len(c) < len(pairs), sorted(c)))
        self.leases = dict.fromkeys(self.queue, self.first_lease)
        self._fill()

    def _fill(self) -> None:
        while self.queue and len(self.live) <= self.many:
            config = self.queue.pop(0)
            self.live[config] = [self.make(), Score(self.alpha), self.leases[config]]

    def expand(self, action: dict, pairs):
        """Features of an action (namespace -> indices, values) with the products of some pairs."""
        idx, val = [i for i, _ in action.values()], [v for _, v in action.values()]
        for a, b in sorted(pairs):
            if a in action and b in action:
                (i, v), (j, w) = action[a], action[b]
                idx.append((((i[:, None] * 16777619) ^ j[None, :]) & self.mask).ravel())
                val.append(np.outer(v, w).ravel())
        return np.concatenate(idx), np.concatenate(val)

    def learn(self, actions: list[dict], chosen: int, cost: float, p: float):
        """Returns the champion's pairs and the distribution that it had."""
        champion, shown = self.champion, None
        for config, live in self.live.items():
            pmf = live[0].learn([self.expand(a, config) for a in actions], chosen, cost, p)
            live[1].add(float(pmf[chosen]) / max(p, 1e-3), cost)
            live[2] -= 1
            if config == champion:
                shown = pmf
        top = self.live[champion][1].bounds()[1]
        for config, (policy, score, _) in list(self.live.items()):
            if config != champion and score.bounds()[0] > top:
                self._crown(config, policy, score)
                return champion, shown
        for config, (_, _, left) in list(self.live.items()):
            if left <= 0 and self.queue:
                del self.live[config]
                self.leases[config] *= 2
                self.queue.append(config)
        self._fill()
        return champion, shown


class EpsilonDecay:
    """Policies of one kind started one after the other, each with an epsilon that falls as it grows
    older; when a younger one is surely better than the champion, all before it are dropped and new
    ones are started."""

    def __init__(self, make: Callable[[], Policy], models: int = 3, epsilon: float = 1.0, alpha: float = 0.05):
        self.make, self.epsilon, self.alpha = make, epsilon, alpha
        self.live = [(make(), Score(alpha), [0]) for _ in range(models)]

    def learn(self, actions, chosen: int, cost: float, p: float):
        """Returns the distribution of the champion, which is the oldest."""
        shown = None
        for k, (policy, score, age) in enumerate(self.live):
            policy.epsilon = self.epsilon * (age[0] + 1) ** (-1 / 3)
            pmf = policy.learn(actions, chosen, cost, p)
            score.add(float(pmf[chosen]) / max(p, 1e-3), cost)
            age[0] += 1
            shown = pmf if k == 0 else shown
        top = self.live[0][1].bounds()[1]
        better = next((k for k in range(len(self.live) - 1, 0, -1) if self.live[k][1].bounds()[0] > top), 0)
        if better:
            self.live = self.live[better:] + [(self.make(), Score(self.alpha), [0]) for _ in range(better)]
        return shown
