"""Learning to search beyond sequences: a hook for tasks of one's own, with beams over selective
branching, and two tasks, labels as paths of a binary tree and entities with relations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .composed import Maker, _base


@dataclass
class Searcher:
    """A cost-sensitive policy over whatever decisions a task makes. A task is a function of
    ``decide(idx, val, allowed, truth)``, which answers with an action, and returns its loss."""

    actions: int
    bits: int = 16
    make: Maker = _base

    def __post_init__(self):
        self.slots = [self.make(self.bits, low=-1e9, high=1e9) for _ in range(self.actions)]

    def scores(self, idx, val):
        return np.array([s._raw(idx, val) for s in self.slots])

    def _best(self, idx, val, allowed):
        scores = self.scores(idx, val)
        return min(range(self.actions) if allowed is None else allowed, key=lambda k: (scores[k], k))

    def run(self, task: Callable) -> float:
        """The task's loss with the policy as it is."""
        return task(lambda idx, val, allowed=None, truth=None: self._best(idx, val, allowed))

    def learn(self, task: Callable) -> float:
        """Follows the policy; at every decision each action's cost is 1 unless it is the true one."""
        steps = []

        def decide(idx, val, allowed=None, truth=None):
            steps.append((idx, val, range(self.actions) if allowed is None else list(allowed), truth))
            return self._best(idx, val, allowed)

        loss = task(decide)
        for idx, val, allowed, truth in steps:
            if truth is not None:
                for k in allowed:
                    self.slots[k].learn(idx, val, float(k != truth), 1.0)
        return loss

    def branch(self, task: Callable, most: int = 8, near: float = math.inf) -> tuple[float, float]:
        """Selective branching: the run of the policy, then runs that once take the second choice, at
        the decisions where it was nearest. (score of the best run, its loss); a run's score is the
        sum of its decisions' predicted costs."""

        def follow(change: int | None):
            total, gaps = 0.0, []

            def decide(idx, val, allowed=None, truth=None):
                nonlocal total
                scores = self.scores(idx, val)
                order = sorted(range(self.actions) if allowed is None else allowed, key=lambda k: (scores[k], k))
                k = order[1] if change == len(gaps) and len(order) > 1 else order[0]
                gaps.append(scores[order[1]] - scores[order[0]] if len(order) > 1 else math.inf)
                total += scores[k]
                return k

            loss = task(decide)
            return total, loss, gaps

        total, loss, gaps = follow(None)
        runs = [(total, 0, loss)]
        for n, at in enumerate(sorted((i for i, g in enumerate(gaps) if g < near), key=lambda i: gaps[i])[:most], 1):
            t, other, _ = follow(at)
            runs.append((t, n, other))
        best = min(runs)
        return best[0], best[2]


def multiclass_task(idx, val, label: int, classes: int, bits: int):
    """A class (from 0) as the path of a binary tree: one decision for each bit of its number."""
    depth = max(1, math.ceil(math.log2(classes)))

    def task(decide):
        at, out = 1, 0
        for level in reversed(range(depth)):
            feature = np.append(idx, (at * 2654435761) % (1 << bits)), np.append(val, 1.0)
            joined = ((feature[0] * 31 + at * 977) % (1 << bits)).astype(np.int64)
            bit = decide(np.concatenate([joined, feature[0]]), np.concatenate([feature[1], feature[1]]), [0, 1], (label >> level) & 1)
            at, out = 2 * at + bit, 2 * out + bit
        task.label = min(out, classes - 1)
        return float(task.label != label)

    return task


def entity_relation_task(entities, relations, types: int, kinds: int, allowed: Callable[[int, int], list[int]], bits: int):
    """Types of entities, then kinds of relations that the types allow. ``entities`` are (idx, val,
    type); ``relations`` (first, second, idx, val, kind); actions below ``types`` are types, those
    after them kinds. The loss is the share of wrong labels."""

    def task(decide):
        wrong, found = 0, []
        for idx, val, truth in entities:
            found.append(decide(idx, val, list(range(types)), truth))
            wrong += found[-1] != truth
        task.types, task.kinds = found, []
        for a, b, idx, val, truth in relations:
            own = np.append(idx, [(found[a] * 7919 + 13) % (1 << bits), (found[b] * 104729 + 17) % (1 << bits)])
            may = [types + k for k in allowed(found[a], found[b])]
            k = decide(own.astype(np.int64), np.append(val, [1.0, 1.0]), may, types + truth if types + truth in may else None) - types
            task.kinds.append(k)
            wrong += k != truth
        return wrong / max(len(entities) + len(relations), 1)

    return task
