"""Bandit simulations and policies' bookkeeping: supervised data as bandits, warm starts, confidence
sequences, interaction-grounded learning, low-rank and stage-wise polynomial models."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exploration as X
from .composed import GD, Policy, _base
from .online import Kernel, loss_slope


def cbify(df: DataFrame, label: str, costs: Column, epsilon: float = 0.05, seed: int = 0, *keys: str, loss0: float = 0.0, loss1: float = 1.0) -> DataFrame:
    """Classification rows as logged bandit events: an action drawn from an exploring policy over
    ``costs``, its probability, and ``loss0`` if it is the label (from 0), else ``loss1``. The draw is a
    hash of the keys, so that reruns agree; nothing is shuffled."""
    pmf = X.epsilon_greedy(costs, epsilon)
    drawn = df.withColumn("__pmf", pmf).withColumn("chosen", X.sample(F.col("__pmf"), X.uniform_draw(*[F.col(k) for k in keys], F.lit(seed))))
    return drawn.withColumn("p", F.get("__pmf", F.col("chosen"))).withColumn("cost", F.when(F.col("chosen") == F.col(label), F.lit(loss0)).otherwise(F.lit(loss1))).drop("__pmf")


def cbify_costs(df: DataFrame, costs: Column, policy: Column, draw: Column) -> DataFrame:
    """Cost-sensitive rows as logged bandit events: an action drawn (by ``draw``, 0 to 1) from the
    distribution that ``policy`` has over its own scores, its probability and its cost."""
    drawn = df.withColumn("__pmf", policy).withColumn("chosen", X.sample(F.col("__pmf"), draw))
    return drawn.withColumn("p", F.get("__pmf", F.col("chosen"))).withColumn("cost", F.get(costs, F.col("chosen"))).drop("__pmf")


def cbify_regression(df: DataFrame, label: Column, bins: int, low: float, high: float, policy: Column, draw: Column, loss: str = "squared") -> DataFrame:
    """Regression rows as bandit events over ``bins`` equal stretches from low to high: the cost of an
    action is the loss of its middle, over the width (absolute) or its square (squared), or whether
    the label is outside of it (zero_one)."""
    unit = (high - low) / bins
    middle = lambda j: low + (j + 0.5) * unit
    far = lambda j: F.abs(label - middle(j))
    cost = {"squared": lambda j: far(j) * far(j) / (high - low) ** 2, "absolute": lambda j: far(j) / (high - low), "zero_one": lambda j: F.when(far(j) <= unit / 2, 0.0).otherwise(1.0)}[loss]
    return cbify_costs(df, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), cost), policy, draw)


def corrupt(label: Column, classes: int, probability: float, kind: str, *keys: Column) -> Column:
    """Labels with noise: uniform, the next class, or always the first, with a probability by hash."""
    hit = X.uniform_draw(*keys, F.lit("corrupt")) < probability
    other = {"uniform": F.floor(X.uniform_draw(*keys, F.lit("to")) * classes).cast("int"), "circular": (label + 1) % classes, "overwrite": F.lit(0)}[kind]
    return F.when(hit, other).otherwise(label)


def masked_actions(kept: DataFrame, actions: DataFrame, event: str, action: str) -> DataFrame:
    """Actions that were pruned before a decision come back with probability 0."""
    return actions.join(kept, [event, action], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


@dataclass
class WarmStart:
    """A bandit after a supervised warm start: candidates weigh both kinds of examples by their own
    share, and the one with the least cumulative estimated cost decides."""

    shares: tuple[float, ...] = (0.0, 0.125, 0.25, 0.5, 0.75, 1.0)
    classes: int = 2
    epsilon: float = 0.05
    bits: int = 12

    def __post_init__(self):
        self.models = [[_base(self.bits, low=-1e9, high=1e9) for _ in range(self.classes)] for _ in self.shares]
        self.costs, self.seen = np.zeros(len(self.shares)), [0, 0]

    def _learn(self, m, idx, val, costs, weight):
        if weight > 0:
            for k, c in enumerate(costs):
                self.models[m][k].learn(idx, val, c, weight)

    def warm(self, idx, val, label):
        self.seen[0] += 1
        for m, share in enumerate(self.shares):
            self._learn(m, idx, val, [float(k != label) for k in range(self.classes)], 1 - share)

    def choose(self, idx, val, m=None):
        m = int(self.costs.argmin()) if m is None else m
        return int(np.argmin([x._raw(idx, val) for x in self.models[m]]))

    def interact(self, idx, val, action, cost, p):
        self.seen[1] += 1
        before = self.choose(idx, val)
        for m, share in enumerate(self.shares):
            self.costs[m] += cost / p * (self.choose(idx, val, m) == action)
            self._learn(m, idx, val, [cost / p if k == action else 0.0 for k in range(self.classes)], share)
        return before


class ConfidenceSequence:
    """Bounds on the mean of weighted rewards in [low, high] that hold at every time at once: a mixture
    of betting martingales over a grid of stakes, inverted by bisection."""

    STAKES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7)

    def __init__(self, alpha: float = 0.05, low: float = 0.0, high: float = 1.0):
        self.alpha, self.low, self.high, self.values = alpha, low, high, []

    def update(self, weight: float, reward: float) -> None:
        self.values.append((weight, reward))

    def _wealth(self, mean: float, upward: bool) -> float:
        """Log of the wealth of betting that the mean is above (below) ``mean``; outcomes are at least 0."""
        x = np.array([w * (r - self.low) / (self.high - self.low) if upward else w * (self.high - r) / (self.high - self.low) for w, r in self.values])
        m = mean if upward else 1 - mean
        logs = [np.log1p(np.maximum(s * (x - m), -0.999)).sum() for s in self.STAKES]
        top = max(logs)
        return top + math.log(sum(math.exp(v - top) for v in logs) / len(logs))

    def bounds(self) -> tuple[float, float]:
        if not self.values:
            return self.low, self.high
        limit, out = math.log(2 / self.alpha), []
        for upward in (True, False):
            a, b = 0.0, 1.0
            for _ in range(40):
                m = (a + b) / 2
                refuted = self._wealth(m if upward else 1 - m, upward) > limit
                a, b = (m, b) if refuted else (a, m)
            out.append(a)
        scale = self.high - self.low
        return self.low + out[0] * scale, self.high - out[1] * scale


class DecayedBounds:
    """Chi-squared bounds over sums in which older events fade by ``tau``: weights for robust learning."""

    def __init__(self, tau: float = 0.999, alpha: float = 0.05):
        self.tau, self.alpha, self.sums = tau, alpha, np.zeros(6)

    def update(self, w: float, r: float) -> float:
        from ..functions.estimators import chi2_lower_bound

        self.sums = self.tau * self.sums + np.array([1, w, w * w, w * r, w * w * r, w * w * r * r])
        return chi2_lower_bound(*self.sums, alpha=self.alpha)


class Grounded:
    """Interaction-grounded learning: no reward is logged, only feedback. A decoder learns which
    feedback goes with the chosen action rather than chance; what it recognises is the reward."""

    def __init__(self, bits: int = 12, **policy):
        self.decoder, self.policy = _base(bits, "logistic"), Policy(bits=bits, **policy)

    def learn(self, actions, feedback, chosen, p, bad=False):
        for k, (i, v) in enumerate(actions):
            x = np.concatenate([i, feedback[0]]), np.concatenate([v, feedback[1]])
            self.decoder.learn(*x, 1.0 if k == chosen else -1.0, 0.25 / p if k == chosen else 0.75 / max(1 - p, 1e-3))
        x = np.concatenate([actions[chosen][0], feedback[0]]), np.concatenate([actions[chosen][1], feedback[1]])
        decoded = self.decoder.predict(*x) > 0
        cost = (-1.0 + 3.0 * bad) if decoded else 0.0
        return cost, self.policy.learn(actions, chosen, cost, p)


class Distilled(Policy):
    """Random network distillation: actions whose features a trained copy of a random function
    does not yet know get a bonus."""

    def __init__(self, alpha: float = 0.1, **kw):
        super().__init__(**kw)
        rng = np.random.default_rng(self.seed)
        self.alpha, self.target, self.copy = alpha, rng.normal(size=1 << self.bits), _base(self.bits, low=-1e9, high=1e9)

    def costs(self, actions, model=0):
        bonus = [abs(float(self.target[i] @ v) - self.copy._raw(i, v)) for i, v in actions]
        return super().costs(actions, model) - self.alpha * np.array(bonus)

    def learn(self, actions, chosen, cost, p):
        out = super().learn(actions, chosen, cost, p)
        i, v = actions[chosen]
        self.copy.learn(i, v, float(self.target[i] @ v), 1.0)
        return out


class Confident(Policy):
    """Optimism or elimination by cost intervals: how far a prediction can be moved at a bounded
    increase in loss says how wide an action's interval is."""

    def __init__(self, mellowness: float = 0.1, optimistic: bool = False, low: float = 0.0, high: float = 1.0, **kw):
        super().__init__(**kw)
        self.mellowness, self.optimistic, self.low, self.high = mellowness, optimistic, low, high

    def intervals(self, actions):
        budget = self.mellowness * math.log(max(self.events, 2))
        out = []
        for i, v in actions:
            c, s = self.models[0]._raw(i, v), self.models[0].sensitivity(i, v) if self.events else 1.0
            # Weight w moves the prediction by s w and costs about w gap^2: the largest with cost in budget.
            width = [min(abs(c - edge), math.sqrt(max(s, 1e-9) * budget)) for edge in (self.low - 1, self.high + 1)]
            out.append((min(max(c - width[0], self.low), self.high), min(max(c + width[1], self.low), self.high)))
        return np.array(out)

    def distribution(self, actions):
        ranges = self.intervals(actions)
        if self.optimistic:
            p = ranges[:, 0] == ranges[:, 0].min()
        else:
            p = ranges[:, 0] <= ranges[:, 1].min()
        return p / p.sum()


def graph_feedback(costs: np.ndarray, graph: np.ndarray, gamma: float, rounds: int = 400) -> np.ndarray:
    """A distribution for feedback that an action gives on its neighbours too: projected descent on
    expected regret plus the inverse of how often each action's feedback is seen."""
    k = len(costs)
    p = np.full(k, 1 / k)
    gap = costs - costs.min()
    for t in range(1, rounds + 1):
        seen = np.maximum(graph.T @ p, 1e-9)
        slope = gap - (graph @ ((1 - p) ** 2 / seen**2)) / (4 * gamma) - 2 * (1 - p) / seen / (4 * gamma)
        p = _simplex(p - 0.5 / (gamma * math.sqrt(t)) * slope / max(np.abs(slope).max(), 1e-9))
    return p


def _simplex(x: np.ndarray) -> np.ndarray:
    s = np.sort(x)[::-1]
    total = np.cumsum(s) - 1
    k = np.flatnonzero(s - total / np.arange(1, len(x) + 1) > 0)[-1]
    return np.maximum(x - total[k] / (k + 1), 0)


@dataclass
class LowRank(Kernel):
    """A linear model with rank-k factors between two namespaces (indices below and from ``split``),
    one side learnt while the other stands still, in turn."""

    rank: int = 4
    split: int = 1 << 13
    rate: float = 0.1
    dropout: bool = False
    loss: str = "squared"
    bits: int = 14

    def __post_init__(self):
        rng = np.random.default_rng(0)
        self.rng, self.base = rng, GD(loss=self.loss, bits=self.bits, low=-1e9, high=1e9)
        self.v = rng.normal(size=(1 << self.bits, self.rank)) * 0.1
        self.turn = 0

    def _sides(self, idx, val):
        left = idx < self.split
        return left, val[left] @ self.v[idx[left]], val[~left] @ self.v[idx[~left]]

    def predict(self, idx, val):
        _, a, b = self._sides(idx, val)
        return self.base._raw(idx, val) + float(a @ b)

    def learn(self, idx, val, y, weight):
        p = self.predict(idx, val)
        left, a, b = self._sides(idx, val)
        keep = self.rng.integers(0, 2, self.rank) if self.dropout else 1
        d = loss_slope(self.loss, p, y) * weight * self.rate
        self.turn = 1 - self.turn
        side, other = (left, b) if self.turn else (~left, a)
        self.v[idx[side]] -= d * np.outer(val[side], other * keep)
        self.base.learn(idx, val, y - float(a @ b), weight)
        return p

    def rows(self):
        return self.base.rows()


@dataclass
class StagePolynomial(Kernel):
    """Polynomial features that grow by stages: at the end of a stage the heaviest features become
    parents, whose products with an example's features join the model."""

    stage: int = 200
    grow: float = 1.0
    bits: int = 14

    def __post_init__(self):
        self.base, self.parents, self.n, self.sizes = GD(bits=self.bits), set(), 0, 0

    def _expanded(self, idx, val):
        extra_i, extra_v = [], []
        have = [(i, v) for i, v in zip(idx.tolist(), val.tolist(), strict=True) if i in self.parents]
        for i, v in have:
            extra_i += [(i * 16777619 ^ j) & ((1 << self.bits) - 1) for j in idx.tolist()]
            extra_v += (v * val).tolist()
        return np.concatenate([idx, np.array(extra_i, np.int64)]), np.concatenate([val, np.array(extra_v)])

    def predict(self, idx, val):
        return self.base.predict(*self._expanded(idx, val))

    def learn(self, idx, val, y, weight):
        x = np.unique(self._expanded(idx, val)[0], return_index=True)
        full = self._expanded(idx, val)
        p = self.base.learn(x[0], full[1][x[1]], y, weight)
        self.n, self.sizes = self.n + 1, self.sizes + len(idx)
        if self.n % self.stage == 0:
            weights = np.abs(self.base.w) * np.maximum(self.base.norm, 1e-12)
            weights[list(self.parents)] = 0
            many = max(1, int((self.sizes / self.n) ** self.grow))
            self.parents |= {int(i) for i in np.argsort(-weights, kind="stable")[:many] if weights[i] > 0}
        return p

    def rows(self):
        return self.base.rows()


def graph_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Labels of (node, label, score) spread over edges (a, b): each round a node without a label takes
    the one that most labelled neighbours have, the least of ties. A round is one join and one aggregation."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    for _ in range(rounds):
        votes = both.join(nodes.where("label IS NOT NULL").select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("x")).select("node", (-F.col("x.l")).alias("vote"))
        nodes = nodes.join(best, "node", "left").select("node", F.coalesce("label", "vote").alias("label"))
    return nodes
