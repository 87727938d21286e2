"""Distributions over actions, as Column expressions on arrays: one event is one row, nothing is shuffled.

Costs and scores are array<double>; the result is an array of probabilities in the same order.
Where several actions are best, ``first`` ones are those with the lowest position. What a lambda
uses more than once is bound by ``let``, so that it is computed once for the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def normalised(xs: Column) -> Column:
    """Shares of the total; uniform where the total is not positive."""
    return let(xs, lambda v: let(total(v), lambda t: F.transform(v, lambda x: F.when(t > 0, x / t).otherwise(1.0 / F.size(v)))))


def shares(weights: Column) -> Column:
    """Positive weights over their total; null where one of them is null."""
    return let(weights, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))


def first_best(costs: Column) -> Column:
    return (F.array_position(costs, F.array_min(costs)) - 1).cast("int")


def epsilon_greedy(costs: Column, epsilon: float | Column) -> Column:
    """epsilon shared by all actions, the rest by those with the least cost."""

    def of(c: Column, best: Column) -> Column:
        ties = F.size(F.filter(c, lambda x: x == best))
        return let(F.struct((epsilon / F.size(c)).alias("low"), ((1.0 - epsilon) / ties).alias("more")), lambda s: F.transform(c, lambda x: s["low"] + F.when(x == best, s["more"]).otherwise(F.lit(0.0))))

    return let(costs, lambda c: let(F.array_min(c), lambda best: of(c, best)))


def softmax(scores: Column, temperature: float) -> Column:
    scaled = F.transform(scores, lambda s: s * temperature)
    return normalised(let(scaled, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda s: F.exp(s - top)))))


def bag(votes: Column) -> Column:
    """Shares of policies that chose each action."""
    return normalised(F.transform(votes, lambda v: v.cast("double")))


def explore_first(costs: Column, seen: Column, tau: int, epsilon: float = 0.0) -> Column:
    """Uniform for the first ``tau`` events, then greedy to the first best action."""

    def of(c: Column, best: Column) -> Column:
        k = F.size(c)
        return F.transform(c, lambda _, i: F.when(seen < tau, 1.0 / k).otherwise(epsilon / k + F.when(i == best, F.lit(1.0 - epsilon)).otherwise(F.lit(0.0))))

    return let(costs, lambda c: let(first_best(c), lambda best: of(c, best)))


def squarecb(costs: Column, gamma: float | Column) -> Column:
    """Inverse gap weighting: 1 / (K + gamma * gap), the first best action gets what is left."""

    def gaps(c: Column, s: Column) -> Column:
        return F.transform(c, lambda x, i: F.when(i == s["at"], F.lit(0.0)).otherwise(1.0 / (F.size(c) + gamma * (x - s["best"]))))

    def filled(g: Column, s: Column) -> Column:
        return let(1.0 - total(g), lambda rest: F.transform(g, lambda p, i: F.when(i == s["at"], rest).otherwise(p)))

    return let(costs, lambda c: let(F.struct(first_best(c).alias("at"), F.array_min(c).alias("best")), lambda s: let(gaps(c, s), lambda g: filled(g, s))))


def mix_uniform(pmf: Column, epsilon: float) -> Column:
    return let(pmf, lambda v: F.transform(v, lambda p: p * (1.0 - epsilon) + epsilon / F.size(v)))


def minimum_probability(pmf: Column, epsilon: float, raise_zeros: bool = True) -> Column:
    """The nearest distribution whose probabilities are epsilon / K at least: a projection on the
    simplex above that floor. With ``raise_zeros`` off, zeros stay and do not count for K."""
    if epsilon <= 0:
        return pmf

    def project(v: Column, k: Column) -> Column:
        if epsilon > 0.999:
            return F.transform(v, lambda p: F.when(F.lit(raise_zeros) | (p > 0), 1.0 / k).otherwise(p))
        floor = epsilon / k
        ordered = F.reverse(F.array_sort(v if raise_zeros else F.filter(v, lambda p: p > 0)))

        def step(s: Column, p: Column) -> Column:
            # The n largest stay above the floor if the shift that brings the total to 1 leaves them there.
            n, sum_ = s["n"] + 1, s["sum"] + p
            shift = ((k - n) * floor + sum_ - 1.0) / n
            return F.struct(n.alias("n"), sum_.alias("sum"), F.when((p > shift + floor) | (n == 1), shift).otherwise(s["shift"]).alias("shift"))

        shift = F.aggregate(ordered, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("shift")), step, lambda s: s["shift"])
        return let(shift, lambda by: F.transform(v, lambda p: F.when(F.lit(raise_zeros) | (p > 0), F.greatest(p - by, floor)).otherwise(p)))

    return let(pmf, lambda v: let(F.size(v) if raise_zeros else F.size(F.filter(v, lambda p: p > 0)), lambda k: project(v, k)))


def synthetic_cover(costs: Column, psi: float, size: int) -> Column:
    """``size`` policies one after the other take the action that is cheapest after a charge of
    psi / size for each policy that has it: water filling, by a fold inside the row."""

    def step(c: Column, state: Column) -> Column:
        charged = F.zip_with(c, state, lambda x, n: x + n * psi / size)
        return let(first_best(charged), lambda at: F.transform(state, lambda n, i: n + F.when(i == at, F.lit(1.0)).otherwise(F.lit(0.0))))

    return let(costs, lambda c: normalised(F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.transform(c, lambda _: F.lit(0.0)), lambda state, _: step(c, state))))


def sample(pmf: Column, draw: Column, scaled: bool = True) -> Column:
    """Position of the action that a number in [0, 1) falls on, by the inverse of the cumulative distribution.
    With ``scaled`` off, the number is compared as it is, however far the sum of ``pmf`` is from 1."""

    def of(v: Column, target: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            sum_ = s["sum"] + p
            return F.struct(sum_.alias("sum"), F.when((s["at"] < 0) & (sum_ > target), s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"), F.lit(0).alias("i"))
        return F.aggregate(v, start, step, lambda s: F.when(s["at"] < 0, s["i"] - 1).otherwise(s["at"]))

    return let(pmf, lambda v: let(draw * total(v) if scaled else draw, lambda target: of(v, target)))


def swap_to_front(actions: Column, at: Column) -> Column:
    """The chosen action first, the first in its place."""
    return let(actions, lambda v: F.transform(v, lambda a, i: F.when(i == 0, F.get(v, at)).when(i == at, F.get(v, F.lit(0))).otherwise(a)))


def order_actions(pmf: Column, costs: Column) -> Column:
    """Positions by probability (high first), then cost, then position."""
    rows = F.transform(F.arrays_zip(pmf.alias("p"), costs.alias("c")), lambda x, i: F.struct((-x["p"]).alias("p"), x["c"].alias("c"), i.alias("i")))
    return F.transform(F.array_sort(rows), lambda x: x["i"])


def uniform_draw(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that reruns and recovered tasks agree."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / float(1 << 40)


def epsilon_schedule(epsilon: float, n: Column, exponent: float = -1 / 3) -> Column:
    return epsilon * F.pow(n + 1.0, F.lit(exponent))
