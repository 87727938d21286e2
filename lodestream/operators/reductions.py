"""Reductions between learning problems as DataFrame and array rewrites.

A multi-action event is one row with arrays (costs, scores, features of its actions): what a
reduction does to an event needs no shuffle. Ties go to the lowest class or position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exploration import let, total


#: Most weights that are broadcast to score with.
MOST_SENT = 2_000_000


def linear_score(examples: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """(keys..., slots of ``weights``, score): sparse dot products of exploded features (ns, name, value)
    with weights (ns, name, w, and any slot columns such as a class). The weights are broadcast if
    counted small: the constant is in every example, so that the other way one task would have it
    from all of them. Sums are combined before the shuffle by key."""
    slots = [c for c in weights.columns if c not in ("ns", "name", "w")]
    weights = F.broadcast(weights) if weights.count() <= MOST_SENT else weights
    return examples.join(weights, ["ns", "name"]).groupBy(*keys, *slots).agg(F.sum(F.col("value") * F.col("w")).alias("score"))


def binary(score: Column) -> Column:
    return F.when(score > 0, 1).otherwise(-1)


def argmax(xs: Column) -> Column:
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def argmin(xs: Column) -> Column:
    return (F.array_position(xs, F.array_min(xs)) - 1).cast("int")


def oaa_probabilities(scores: Column) -> Column:
    """Logistic of each class's score, brought to a total of 1."""
    each = F.transform(scores, lambda s: 1 / (1 + F.exp(-s)))
    return let(each, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))


def oaa_examples(df: DataFrame, label: str, classes: int) -> DataFrame:
    """k binary problems for each example: (..., class, y)."""
    return df.withColumn("class", F.explode(F.sequence(F.lit(1), F.lit(classes)))).withColumn("y", F.when(F.col(label) == F.col("class"), 1.0).otherwise(-1.0))


def ect_rounds(classes: int) -> list[list[tuple[int, int | None]]]:
    """Plan-time single-elimination tournament: pairings of each round, None for a bye."""
    alive, rounds = [[k] for k in range(1, classes + 1)], []
    while len(alive) > 1:
        rounds.append([(a[0], b[0] if b else None) for a, b in zip(alive[::2], [*alive[1::2], None], strict=False)])
        alive = [a + (b or []) for a, b in zip(alive[::2], [*alive[1::2], None], strict=False)]
    return rounds


def cost_sensitive_loss(costs: Column, chosen: Column, absolute: bool = False) -> Column:
    own = F.get(costs, chosen)
    return own if absolute else own - F.array_min(costs)


def ldf_rank(scores: Column) -> Column:
    """Positions by score, lowest first."""
    rows = F.array_sort(F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
    return F.transform(rows, lambda r: r["i"])


def mc_weights(costs: Column) -> tuple[Column, Column]:
    """Costs as classification: label -1 for the cheapest, +1 for others; weight is how much the choice matters."""
    labels = let(F.array_min(costs), lambda low: F.transform(costs, lambda c: F.when(c == low, -1.0).otherwise(1.0)))
    ends = F.struct(F.array_min(costs).alias("low"), F.array_max(costs).alias("high"))
    weights = let(ends, lambda e: F.transform(costs, lambda c: F.when(c == e["low"], e["high"] - e["low"]).otherwise(c - e["low"])))
    return labels, weights


def wap_values(costs: Column) -> Column:
    """Weighted all pairs: running total of gaps between sorted costs, each over its rank, in the costs' order."""
    ordered = F.array_sort(F.transform(costs, lambda c, i: F.struct(c.alias("c"), i.alias("i"))))

    def step(s: Column, r: Column) -> Column:
        v = F.when(s["n"] == 0, F.lit(0.0)).otherwise(s["v"] + (r["c"] - s["c"]) / s["n"])
        return F.struct((s["n"] + 1).alias("n"), r["c"].alias("c"), v.alias("v"), F.array_append(s["out"], F.struct(r["i"].alias("i"), v.alias("v"))).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("c"), F.lit(0.0).alias("v"), F.expr("CAST(array() AS array<struct<i:int,v:double>>)").alias("out"))
    return F.transform(F.array_sort(F.aggregate(ordered, start, step, lambda s: s["out"])), lambda r: r["v"])


def wap_pairs(costs: Column) -> Column:
    """(i, j, difference) of every pair of an event's actions with different values, i before j."""

    def of(values: Column) -> Column:
        return F.flatten(F.transform(values, lambda x, i: F.transform(F.slice(values, i + 2, F.size(values)), lambda y, j: F.struct(i.alias("i"), (i + 1 + j).alias("j"), F.abs(x - y).alias("weight")))))

    return F.filter(let(wap_values(costs), of), lambda p: p["weight"] > 1e-6)


def classweight(label: Column, weights: dict[int, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), label), F.lit(1.0))


def top_k(scores: Column, k: int) -> Column:
    """(position, score) of the k largest, largest first."""
    rows = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(r["i"].alias("i"), (-r["s"]).alias("score")))


def multilabel(scores: Column, threshold: float = 0.0) -> Column:
    """Positions of the classes that score above the threshold."""
    return F.transform(F.filter(F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda r: r["s"] > threshold), lambda r: r["i"])


def poisson_weight(*keys: Column) -> Column:
    """A Poisson(1) count that depends on the keys alone."""
    u = F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) / 1_000_003.0
    out, total, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 12):
        total, p = total + p, p / k
        out = F.when(u >= total, k).otherwise(out)
    return out


def bootstrap(predictions: Column, kind: str = "mean") -> Column:
    """One prediction from an array of replicas': their mean, or the most frequent (lowest of ties)."""
    if kind == "mean":
        return F.aggregate(predictions, F.lit(0.0), lambda a, x: a + x) / F.size(predictions)

    def vote(distinct: Column) -> Column:
        counts = F.transform(distinct, lambda d: F.size(F.filter(predictions, lambda x: x == d)))
        return let(counts, lambda n: F.get(distinct, F.array_position(n, F.array_max(n)).cast("int") - 1))

    return let(F.array_sort(F.array_distinct(predictions)), vote)


def boosting_weight(learner: int, learners: int, margin: Column, gamma: float) -> Column:
    """Boost-by-majority weight of a weak learner given the sum of those before it."""
    left = learners - learner - 1
    k = F.floor((learners - learner - margin) / 2)
    ways = F.expr("1.0")
    table = [_choose(left, j) for j in range(left + 1)]
    ways = F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in table]), k.cast("int")), F.lit(0.0))
    return F.when((k < 0) | (k > left), F.lit(0.0)).otherwise(ways * F.pow(F.lit(0.5 + gamma), k) * F.pow(F.lit(0.5 - gamma), left - k))


def _choose(n: int, k: int) -> int:
    out = 1
    for j in range(k):
        out = out * (n - j) // (j + 1)
    return out


def plt_ancestors(label: Column, arity: int, labels: int) -> Column:
    """Nodes on the path from a label's leaf to the root of a complete tree, numbered breadth first."""
    internal = (labels - 1 + arity - 2) // (arity - 1)
    depth = 1
    while arity**depth < labels + internal:
        depth += 1

    def step(path: Column, _: Column) -> Column:
        at = F.element_at(path, -1)
        return F.when(at > 0, F.array_append(path, F.floor((at - 1) / arity).cast("int"))).otherwise(path)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth + 1)), F.array((label + internal).cast("int")), step)


def event_rows(df: DataFrame, event: list[str], order: list[str], **columns: str) -> DataFrame:
    """Multi-line events: the rows of an event become arrays in order, one shuffle by event."""
    packed = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"__{k}") for k, c in columns.items()])))
    one = df.groupBy(*event).agg(packed.alias("rows"))
    return one.select(*event, *[F.transform("rows", _field(f"__{k}")).alias(k) for k in columns])


def _field(name: str):
    return lambda r: r[name]
