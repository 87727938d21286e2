import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators import batch, composed, features, online

X = [(np.array([0, 1]), np.array([x, 1.0]), 1.0 if x > 0.2 else -1.0) for x in np.random.default_rng(1).normal(size=400)]


def errors(model, passes=1):
    wrong = 0
    for _ in range(passes):
        wrong = 0
        for i, v, y in X:
            wrong += (model.learn(i, v, y, 1.0) > 0) != (y > 0)
        model.end_pass()
    return wrong / len(X)


@pytest.mark.parametrize(
    "make",
    [
        lambda: online.GD(loss="logistic", bits=1), lambda: online.GD(loss="hinge", bits=1), lambda: online.GD(loss="squared", bits=1), lambda: online.FTRL(bits=1), lambda: online.Pistol(bits=1), lambda: online.Coin(bits=1),
        lambda: online.FreeGrad(bits=1), lambda: online.NeuralNet(bits=1), lambda: composed.OneAgainstAll(classes=2, bits=1), lambda: composed.KernelMachine(), lambda: composed.Active(bits=1), lambda: composed.OjaNewton(size=1, bits=1),
    ],
)
def test_learners_learn(make):
    model = make()
    if isinstance(model, composed.OneAgainstAll):
        wrong = sum(model.learn(i, v, 1.0 if y > 0 else 2.0, 1.0) != (1.0 if y > 0 else 2.0) for i, v, y in X) / len(X)
    else:
        wrong = errors(model, 2)
    assert wrong < 0.25
    at, w, _ = model.rows()
    assert len(at) == len(w) and np.isfinite(w).all()


@settings(max_examples=60, deadline=None)
@given(p=st.floats(-3, 3), y=st.sampled_from([-1.0, 1.0]), rate=st.floats(0.01, 3), per=st.floats(0.01, 5), loss=st.sampled_from(["squared", "logistic", "hinge", "quantile"]))
def test_invariant_step_is_the_limit_of_small_ones(p, y, rate, per, loss):
    q, n = p, 4000
    for _ in range(n):
        q -= online.loss_slope(loss, q, y) * per * rate / n
    assert p + online.invariant_step(loss, p, y, rate, per) * per == pytest.approx(q, abs=2e-2)


def test_importance_weight_is_repetition():
    a, b = (online.GD(loss="logistic", adaptive=False, normalized=False, power=0.0, bits=1) for _ in range(2))
    i, v = np.array([0]), np.array([1.0])
    a.learn(i, v, 1.0, 2.0)
    b.learn(i, v, 1.0, 1.0), b.learn(i, v, 1.0, 1.0)
    assert a.predict(i, v) == pytest.approx(b.predict(i, v), abs=1e-6)


def test_trees_and_tournaments():
    rows = [(np.array([k % 6]), np.ones(1), float(k % 6)) for k in range(600)]
    for model, shift in ((composed.LabelTree(labels=6, bits=4), 0), (composed.Tournament(classes=6, bits=4), 1), (composed.LogTree(classes=6, bits=4), 1), (composed.MemoryTree(leaf=4, capacity=50, bits=4), 0)):
        out = [model.learn(i, v, y + shift, 1.0) == y + shift for i, v, y in rows]
        assert sum(out[-100:]) >= 45, type(model).__name__
    tree = composed.MemoryTree(leaf=4, capacity=50, bits=4)
    for i, v, y in rows:
        tree.learn(i, v, y, 1.0)
    assert len(tree.order) <= 50


def test_bandits_find_the_best_action():
    rng = np.random.default_rng(0)
    for kw in ({}, {"estimator": "dr"}, {"estimator": "ips", "explore": "squarecb"}, {"explore": "bag"}, {"explore": "softmax", "temperature": 5.0}, {"estimator": "dm", "explore": "cover"}):
        policy = composed.Policy(bits=4, **kw)
        actions = [(np.array([k]), np.ones(1)) for k in range(3)]
        for _ in range(300):
            a = int(rng.integers(3))
            before = policy.learn(actions, a, [0.9, 0.1, 0.8][a], 1 / 3)
            assert before.sum() == pytest.approx(1) and (before >= -1e-9).all()
        assert policy.distribution(actions).argmax() == 1
    chosen = policy.slots(actions, [(np.array([8]), np.ones(1)), (np.array([9]), np.ones(1))])
    assert chosen[0][2] != chosen[1][2] and len(chosen[1][0]) == 2


def test_cover_policies_differ():
    """Costs too near for one policy to rule the others out: later policies take what the earlier ones leave."""
    rng, policy = np.random.default_rng(5), composed.Policy(bits=4, explore="cover", epsilon=0.5)
    actions, distinct = [(np.array([k]), np.ones(1)) for k in range(3)], 0
    for _ in range(300):
        a = int(rng.integers(3))
        p = policy.learn(actions, a, [0.5, 0.45, 0.5][a], 1 / 3)
        assert p.sum() == pytest.approx(1) and p.min() > 0
        distinct += len({int(policy.costs(actions, m).argmin()) for m in range(4)}) > 1
    assert distinct > 30
    costs = np.array([policy.costs(actions, m) for m in range(4)])
    assert not any(np.allclose(costs[0], costs[m]) for m in range(1, 4))


def test_continuous_actions():
    tree, rng = composed.CatsTree(bins=8, bits=3), np.random.default_rng(0)
    i, v = np.array([0]), np.ones(1)
    for _ in range(500):
        a = rng.random()
        tree.learn_logged(i, v, a, abs(a - 0.7), 1.0)
    assert abs(tree.predict(i, v) - 0.7) < 0.2


def test_race_and_spanner():
    class Fixed:
        def __init__(self, p):
            self.p = p

        def learn(self, actions, chosen, cost, p):
            return self.p

    race = composed.ChampionRace([Fixed(np.array([0.9, 0.1])), Fixed(np.array([0.1, 0.9]))], least=20)
    for k in range(2000):
        race.learn(None, k % 2, [1.0, 0.0][k % 2], 0.5)
    assert race.champion == 1
    v = np.array([[1, 0.0], [0, 1.0], [0.1, 0.1], [0.9, 0.1]])
    assert composed.spanner(v, 2) in ([0, 1], [1, 3])


def test_structured():
    seq = composed.Sequences(3, bits=8)
    steps = [(np.array([k]), np.ones(1)) for k in (0, 1, 2, 0)]
    for _ in range(60):
        seq.learn(steps, [0, 1, 2, 0])
    assert seq.decode(steps) == [0, 1, 2, 0]
    allowed = composed.bio_allowed(5)
    assert allowed([]) == [0, 1, 3] and allowed([1]) == [0, 1, 2, 3] and allowed([4]) == [0, 1, 3, 4]
    heads = composed.shift_reduce(lambda a, stack, at: {"shift": 1, "left": 0, "right": 2}[a], 3)
    assert len(heads) == 3 and all(0 <= h <= 3 for h in heads)


def test_topics():
    docs = [(np.array([0, 1]) + 2 * (k % 2), np.array([5.0, 5.0])) for k in range(40)]
    lam, theta = composed.lda(docs, 2, 4, passes=5)
    assert theta[0].argmax() != theta[1].argmax() and (theta.max(1) > 0.8).mean() > 0.8
    assert composed._digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-8)


def test_train_holds_order_and_merges(spark):
    rows = [(k % 2, k, [0, 1], [float(v[0]), 1.0], y, 1.0) for k, (_, v, y) in enumerate(X)]
    df = spark.createDataFrame(rows, "shard int, seq long, idx array<long>, val array<double>, y double, weight double").repartition(7)
    out = online.train(df, online.Run(lambda: online.GD(loss="logistic", bits=1)), ["shard"])
    got = {r["seq"]: r["p"] for r in out.where("kind = 'prediction'").collect()}
    for shard in (0, 1):
        model = online.GD(loss="logistic", bits=1)
        for k, (i, v, y) in enumerate(X):
            if k % 2 == shard:
                assert got[k] == pytest.approx(model.learn(i, v, y, 1.0))
    w = out.where("kind = 'weight'").select(F.col("shard").alias("model"), F.lit("").alias("ns"), F.col("idx").cast("string").alias("name"), "w", F.col("state").alias("adapt"), F.lit(1).alias("examples"))
    assert batch.merge(w, state="adapt").count() == 2


def test_lbfgs_reaches_the_optimum(spark):
    rows = [(k, y, 1.0, "a", n, x) for k, (_, v, y) in enumerate(X[:100]) for n, x in (("x", float(v[0])), ("c", 1.0))]
    ex = spark.createDataFrame(rows, "id long, y double, weight double, ns string, name string, value double").cache()
    w, value, _ = batch.lbfgs(ex, "logistic", passes=8, l2=1.0)
    got = {r["name"]: r["w"] for r in w.collect()}
    a = np.array([[v[0], 1.0] for _, v, _ in X[:100]])
    y = np.array([y for *_, y in X[:100]])
    best = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(y * (a @ best)))
        best -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(2), -a.T @ (y * p) + best)
    assert value <= np.log1p(np.exp(-y * (a @ best))).sum() + 0.5 * best @ best + 0.2
    assert got["x"] == pytest.approx(best[0], abs=0.3)
    assert math.isfinite(value)


def test_feature_operators(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, t string").withColumn("features", features.bag_of("t", F.split("t", " ")))
    d = spark.createDataFrame([("a", "alpha", 2.0)], "token string, name string, value double")
    out = {r["id"]: r["features"] for r in features.dictionary(df, d, "t", ["id"]).collect()}
    assert [f["name"] for f in out[1]] == ["a", "b", "alpha"] and [f["name"] for f in out[2]] == ["c"]
