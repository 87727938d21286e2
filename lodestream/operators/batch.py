"""Batch learners: every pass is one aggregation by feature, combined before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import losses
from .reductions import linear_score

KEYS = ["ns", "name"]


def gradient(examples: DataFrame, weights: DataFrame, loss: str = "logistic", key: str = "id", label: str = "y", weight: str = "weight") -> DataFrame:
    """(ns, name, g, h): full gradient and the diagonal of squares at ``weights`` (ns, name, w).

    ``examples`` are exploded features (key, label, weight, ns, name, value). Examples none of whose
    features has a weight score 0."""
    scored = linear_score(examples, weights, key) if weights is not None else None
    rows = examples.join(scored, key, "left") if scored is not None else examples.withColumn("score", F.lit(0.0))
    p = F.coalesce(F.col("score"), F.lit(0.0))
    d = losses.derivative(loss, p, F.col(label)) * F.col(weight)
    return rows.groupBy(*KEYS).agg(F.sum(d * F.col("value")).alias("g"), F.sum(F.abs(d) * F.col("value") * F.col("value")).alias("h"))


def ftrl_weight(z: Column, n: Column, alpha: float, beta: float, l1: float, l2: float) -> Column:
    """The proximal map from accumulated (z, n) to a weight."""
    return F.when(F.abs(z) <= l1, F.lit(0.0)).otherwise(-F.signum(z) * (F.abs(z) - l1) / (l2 + (beta + F.sqrt(n)) / alpha))


def lbfgs(examples: DataFrame, loss: str = "logistic", passes: int = 20, memory: int = 15, l2: float = 0.0, tolerance: float = 1e-3, key: str = "id", label: str = "y", weight: str = "weight", cut=None, prior: DataFrame | None = None):
    """Weights (ns, name, w) by limited-memory BFGS with backtracking; losses and gradients are
    aggregations, vectors are DataFrames keyed by feature and only scalars reach the driver.

    ``cut(df)`` writes a vector to a shared folder between passes, which bounds the lineage. ``prior``
    (ns, name, w0, strength) are weights of an earlier model that these are drawn to, each by its strength."""
    spark = examples.sparkSession
    cut = cut or (lambda df: df.checkpoint())
    zero = examples.select(*KEYS).distinct().withColumn("w", F.lit(0.0))
    w = cut(zero)
    total = lambda w: _objective(examples, w, loss, l2, key, label, weight) + _distance(w, prior)
    history: list[tuple[DataFrame, float]] = []
    value, g = total(w), cut(regularised(gradient(examples, w, loss, key, label, weight), w, l2, prior))
    for _ in range(passes):
        direction, alphas = g.select(*KEYS, F.col("g").alias("d"), "h"), []
        for sy, rho in reversed(history):
            a = rho * (direction.join(sy, KEYS).agg(F.sum(F.col("s") * F.col("d"))).first()[0] or 0.0)
            alphas.append(a)
            direction = cut(direction.join(sy, KEYS).select(*KEYS, (F.col("d") - a * F.col("yy")).alias("d"), "h"))
        direction = direction.select(*KEYS, (F.col("d") / F.greatest("h", F.lit(1e-6))).alias("d"), "h")
        for (sy, rho), a in zip(history, reversed(alphas), strict=True):
            b = rho * (direction.join(sy, KEYS).agg(F.sum(F.col("yy") * F.col("d"))).first()[0] or 0.0)
            direction = cut(direction.join(sy, KEYS).select(*KEYS, (F.col("d") + (a - b) * F.col("s")).alias("d"), "h"))
        slope = g.select(*KEYS, "g").join(direction, KEYS).agg(F.sum(F.col("g") * F.col("d"))).first()[0] or 0.0
        if slope <= 0:
            break
        step, new_value, new = 1.0, None, None
        for _ in range(12):
            new = cut(w.join(direction, KEYS).select(*KEYS, (F.col("w") - step * F.col("d")).alias("w")))
            new_value = total(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        ng = cut(regularised(gradient(examples, new, loss, key, label, weight), new, l2, prior))
        sy = cut(new.alias("n").join(w.alias("o"), KEYS).join(ng.alias("gn"), KEYS).join(g.alias("go"), KEYS).select(*KEYS, (F.col("n.w") - F.col("o.w")).alias("s"), (F.col("gn.g") - F.col("go.g")).alias("yy")))
        curve = sy.agg(F.sum(F.col("s") * F.col("yy"))).first()[0] or 0.0
        done = abs(value - new_value) <= tolerance * max(abs(value), 1e-12)
        if curve > 1e-12:
            history = [*history, (sy, 1 / curve)][-memory:]
        w, g, value = new, ng, new_value
        if done:
            break
    return w, value, spark


def _objective(examples, w, loss, l2, key, label, weight) -> float:
    scored = linear_score(examples, w, key)
    labels = examples.groupBy(key).agg(F.first(label).alias(label), F.first(weight).alias(weight))
    name = losses.LOSSES[loss]
    data = labels.join(scored, key, "left").agg(F.sum(name(F.coalesce("score", F.lit(0.0)), F.col(label)) * F.col(weight)) if loss != "squared" else F.sum(losses.classic(F.coalesce("score", F.lit(0.0)), F.col(label)) * F.col(weight))).first()[0]
    return (data or 0.0) + (0.5 * l2 * (w.agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0) if l2 else 0.0)


def regularised(g: DataFrame, w: DataFrame, l2: float = 0.0, prior: DataFrame | None = None) -> DataFrame:
    """Gradient and diagonal with the pull of l2 to 0, and of a prior to its weights."""
    if l2:
        g = g.join(w, KEYS).select(*KEYS, (F.col("g") + l2 * F.col("w")).alias("g"), (F.col("h") + l2).alias("h"))
    if prior is not None:
        pull = F.coalesce(F.col("strength") * (F.col("w") - F.col("w0")), F.lit(0.0))
        g = g.join(w, KEYS).join(prior.select(*KEYS, "w0", "strength"), KEYS, "left").select(*KEYS, (F.col("g") + pull).alias("g"), (F.col("h") + F.coalesce("strength", F.lit(0.0))).alias("h"))
    return g


def _distance(w: DataFrame, prior: DataFrame | None) -> float:
    if prior is None:
        return 0.0
    return 0.5 * (w.join(prior.select(*KEYS, "w0", "strength"), KEYS).agg(F.sum(F.col("strength") * (F.col("w") - F.col("w0")) ** 2)).first()[0] or 0.0)


def prior_of(examples: DataFrame, weights: DataFrame, loss: str = "logistic", l2: float = 0.0, key: str = "id", label: str = "y", weight: str = "weight") -> DataFrame:
    """(ns, name, w0, strength): a model as the prior of the next one, each weight as strong as the
    curvature that its data gives it (diagonal), plus l2."""
    g = gradient(examples, weights, loss, key, label, weight)
    return g.join(weights, KEYS).select(*KEYS, F.col("w").alias("w0"), (F.col("h") + l2).alias("strength"))


def merge(models: DataFrame, keys: list[str] = KEYS, state: str | None = None) -> DataFrame:
    """Weighted mean of models (model, keys, w, examples[, state]): by the examples each has seen, or,
    for adaptive ones, by each weight's own share of the accumulated state."""
    share = F.col(state) if state else F.col("examples")
    total = models.select("model", "examples").distinct().agg(F.sum("examples")).first()[0] if not state else None
    agg = F.sum(F.col("w") * share)
    return models.groupBy(*keys).agg((agg / (F.sum(share) if state else F.lit(float(total or 1)))).alias("w"), *([F.sum(state).alias(state)] if state else []))


def delta(new: DataFrame, old: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Weights of a model less those of another; a weight that one of them lacks is 0 there."""
    n, o = new.select(*keys, F.col("w").alias("wn")), old.select(*keys, F.col("w").alias("wo"))
    return n.join(o, keys, "full").select(*keys, (F.coalesce("wn", F.lit(0.0)) - F.coalesce("wo", F.lit(0.0))).alias("w"))


def feature_mask(weights: DataFrame, mask: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return weights.join(mask.where("w <> 0").select(*keys), keys, "left_semi")
