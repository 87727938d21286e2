"""Off-policy estimators and what they are made of, as Column expressions and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exploration import let

#: What a logged probability of 0 or less is taken for.
LEAST_PROBABILITY = 1e-3


def guarded(p: Column) -> Column:
    return F.when(p <= 0, F.lit(LEAST_PROBABILITY)).otherwise(p)


def ips(action: Column, logged: Column, cost: Column, p: Column, clip: float = 0.0) -> Column:
    return F.when(action == logged, cost / F.greatest(guarded(p), F.lit(clip))).otherwise(F.lit(0.0))


def doubly_robust(action: Column, logged: Column, cost: Column, p: Column, model: Column, clip: float = 0.0) -> Column:
    return model + F.when(action == logged, (cost - model) / F.greatest(guarded(p), F.lit(clip))).otherwise(F.lit(0.0))


def mtr_weight(p: Column, events: Column, actions: Column, weight: Column | float = 1.0, clip: float = 0.0) -> Column:
    """Weight of the logged action: inverse probability, scaled so that an event counts once however many actions it has."""
    return weight / F.greatest(guarded(p), F.lit(clip)) * (events / actions)


def pseudo_inverse(cost: Column, policy: Column, logged: Column) -> Column:
    """Slates: cost times (sum of the slots' ratios - (slots - 1)), both columns arrays over slots."""
    ratios = F.zip_with(policy, logged, lambda q, p: q / guarded(p))
    return cost * (F.aggregate(ratios, F.lit(0.0), lambda a, r: a + r) - (F.size(logged) - 1))


def cats_loss(predicted: Column, action: Column, cost: Column, pdf: Column, low: float, high: float, actions: int, bandwidth: float) -> Column:
    """Continuous actions: cost over density and width, if the logged action is near the centre of the predicted bin."""
    unit = (high - low) / actions
    bin_ = F.least(F.lit(actions - 1), F.floor((predicted - low) / unit))
    centre = low + bin_ * unit + unit / 2
    width = F.least(F.lit(high), centre + bandwidth) - F.greatest(F.lit(low), centre - bandwidth)
    return F.when((action - centre <= bandwidth) & (centre - action <= bandwidth), cost / (pdf * width)).otherwise(F.lit(0.0))


def pmf_to_pdf(centre: Column, low: float, high: float, bandwidth: float) -> Column:
    """Piecewise constant density: segments (left, right, density) of a point smoothed by the bandwidth."""
    left, right = F.greatest(F.lit(low), centre - bandwidth), F.least(F.lit(high), centre + bandwidth)
    seg = lambda a, b, d: F.struct(a.alias("left"), b.alias("right"), d.alias("density"))
    parts = F.array(seg(F.lit(low), left, F.lit(0.0)), seg(left, right, 1.0 / (right - left)), seg(right, F.lit(high), F.lit(0.0)))
    return F.filter(parts, lambda s: s["right"] > s["left"])


def one_point(chosen: Column, classes: int) -> Column:
    """All probability on one class (from 0)."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == chosen, 1.0).otherwise(0.0))


def spread_pmf(pmf: Column, low: float, high: float, bandwidth: int) -> Column:
    """(left, right, density) of every bin of equal width: each bin's probability is spread evenly over
    the bins up to ``bandwidth`` away that exist."""

    def of(held: Column) -> Column:
        n = F.size(held)
        unit = (F.lit(high) - F.lit(low)) / n

        def density(k: Column) -> Column:
            first = F.greatest(k - bandwidth, F.lit(0))
            near = F.transform(F.sequence(first, F.least(k + bandwidth, n - 1)), lambda j: F.get(held, j) / (F.least(j + bandwidth, n - 1) - F.greatest(j - bandwidth, F.lit(0)) + 1))
            return F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / unit

        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((F.lit(low) + k * unit).alias("left"), (F.lit(low) + (k + 1) * unit).alias("right"), density(k).alias("density")))

    return let(pmf, of)


def continuous_policy(chosen: Column, classes: int, low: float, high: float, bandwidth: int, epsilon: float) -> Column:
    """The density that a tree's bin stands for: spread over the bandwidth, mixed with the uniform one."""
    return mix_pdf(spread_pmf(one_point(chosen, classes), low, high, bandwidth), epsilon, low, high)


def mix_pdf(segments: Column, epsilon: float, low: float, high: float) -> Column:
    return F.transform(segments, lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right"), (s["density"] * (1 - epsilon) + epsilon / (high - low)).alias("density")))


def sample_pdf(segments: Column, draw: Column) -> Column:
    """The point at which the density's mass reaches ``draw`` of its total."""
    mass = F.aggregate(segments, F.lit(0.0), lambda a, s: a + (s["right"] - s["left"]) * s["density"])

    def step(state: Column, s: Column) -> Column:
        own = (s["right"] - s["left"]) * s["density"]
        here = (state["at"].isNull()) & (state["sum"] + own >= draw * mass) & (own > 0)
        return F.struct((state["sum"] + own).alias("sum"), F.when(here, s["left"] + (draw * mass - state["sum"]) / s["density"]).otherwise(state["at"]).alias("at"))

    return F.aggregate(segments, F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at")), step, lambda s: s["at"])


def off_policy_value(df: DataFrame, ratio: Column, cost: Column, *by: str) -> DataFrame:
    """IPS, self-normalised IPS, effective sample size and the sums that bounds are made of."""
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(ratio).alias("sum_w"), F.sum(ratio * ratio).alias("sum_w2"), F.sum(ratio * cost).alias("sum_wr"),
        F.sum(ratio * ratio * cost).alias("sum_w2r"), F.sum(ratio * ratio * cost * cost).alias("sum_w2r2"),
    )
    return sums.withColumn("ips", F.col("sum_wr") / F.col("n")).withColumn("snips", F.try_divide("sum_wr", "sum_w")).withColumn("ess", F.try_divide(F.col("sum_w") * F.col("sum_w"), F.col("sum_w2")))


def chi2_lower_bound(n: float, w: float, w2: float, wr: float, w2r: float, w2r2: float, alpha: float = 0.05, low: float = 0.0, high: float = 1.0, w_low: float = 0.0, w_high: float = math.inf) -> float:
    """Least value of a policy over distributions near the sample in chi-squared divergence with mean
    weight 1, rewards in [low, high]: the dual of the empirical likelihood's quadratic form.

    From sums over the sample; the corners of (weight, reward) stand for one unseen event."""
    if n <= 0:
        return low
    budget = _chi2_isf(alpha)
    best = math.inf
    for corner_w, corner_r in [(None, None), (w_low, low), (min(w_high, 1e6), low)]:
        k, a, b, c, d, e = n, w, w2, wr, w2r, w2r2
        if corner_w is not None:
            k, a, b, c, d, e = k + 1, a + corner_w, b + corner_w**2, c + corner_w * corner_r, d + corner_w**2 * corner_r, e + corner_w**2 * corner_r**2
        mean_w, mean_wr = a / k, c / k
        var_w, cov, var_wr = b / k - mean_w**2, d / k - mean_w * mean_wr, e / k - mean_wr**2
        if var_w <= 1e-12:
            slope, spare, centre = 0.0, max(var_wr, 0.0), mean_wr
        else:
            slope = cov / var_w
            spare, centre = max(var_wr - cov * slope, 0.0), mean_wr + slope * (1 - mean_w)
        room = budget / k - ((1 - mean_w) ** 2 / var_w if var_w > 1e-12 else 0.0)
        if room >= 0:
            best = min(best, centre - math.sqrt(spare * room))
    return min(max(best, low), high) if best < math.inf else low


def _chi2_isf(alpha: float) -> float:
    """Upper quantile of chi-squared with one degree of freedom, by bisection of erfc."""
    a, b = 0.0, 200.0
    for _ in range(100):
        m = (a + b) / 2
        a, b = (m, b) if math.erfc(math.sqrt(m / 2)) > alpha else (a, m)
    return (a + b) / 2
