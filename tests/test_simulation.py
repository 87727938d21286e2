import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import simulation as S


def test_cbify(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).cast("int").alias("label"))
    out = S.cbify(df, "label", F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0)), 0.3, 0, "id").collect()
    assert all(r["p"] == pytest.approx(0.8 if r["chosen"] == 0 else 0.1) and r["cost"] == float(r["chosen"] != r["label"]) for r in out)
    assert 0.75 < sum(r["chosen"] == 0 for r in out) / 2000 < 0.85
    noisy = df.select("label", S.corrupt(F.col("label"), 3, 0.2, "circular", F.col("id")).alias("n")).collect()
    assert 0.15 < sum(r["label"] != r["n"] for r in noisy) / 2000 < 0.25


def test_warm_start():
    w, rng = S.WarmStart(classes=3, bits=4), np.random.default_rng(0)
    for k in range(60):
        w.warm(np.array([k % 3]), np.ones(1), k % 3)
    for k in range(300):
        a = int(rng.integers(3))
        w.interact(np.array([k % 3]), np.ones(1), a, float(a != k % 3), 1 / 3)
    assert [w.choose(np.array([k]), np.ones(1)) for k in range(3)] == [0, 1, 2]


def test_confidence_sequence():
    c, rng = S.ConfidenceSequence(), np.random.default_rng(0)
    assert c.bounds() == (0.0, 1.0)
    for _ in range(500):
        c.update(1.0, float(rng.random() < 0.3))
    low, high = c.bounds()
    assert 0.15 < low < 0.3 < high < 0.45
    d = S.DecayedBounds()
    assert [d.update(1.0, 0.5 + 0.1 * (k % 2)) for k in range(100)][-1] == pytest.approx(0.54, abs=0.05)


def test_policies():
    rng = np.random.default_rng(0)
    actions = [(np.array([k]), np.ones(1)) for k in range(3)]
    for policy in (S.Distilled(bits=4, alpha=0.01), S.Confident(bits=4, mellowness=0.001), S.Confident(bits=4, mellowness=0.001, optimistic=True)):
        for _ in range(400):
            a = int(rng.integers(3))
            policy.learn(actions, a, [0.9, 0.1, 0.8][a], 1 / 3)
        p = policy.distribution(actions)
        assert p.sum() == pytest.approx(1) and p.argmax() == 1
    p = S.graph_feedback(np.array([0.1, 0.5, 0.9]), np.eye(3), 10.0)
    assert p.sum() == pytest.approx(1) and p.argmax() == 0 and (p >= 0).all()


def test_grounded():
    g, rng = S.Grounded(bits=4), np.random.default_rng(0)
    actions = [(np.array([k]), np.ones(1)) for k in range(3)]
    costs = [g.learn(actions, (np.array([8 + int(a == 1)]), np.ones(1)), a, 1 / 3)[0] for a in rng.integers(0, 3, 300).tolist()]
    assert set(costs) <= {0.0, -1.0}


def test_factors_and_polynomials():
    rng = np.random.default_rng(0)
    rows = [(np.array([a, 8 + b]), np.ones(2), 1.0 if a == b else -1.0) for a, b in rng.integers(0, 4, (3000, 2)).tolist()]
    model = S.LowRank(rank=4, split=8, bits=4)
    out = [(model.learn(i, v, y, 1.0) > 0) == (y > 0) for i, v, y in rows]
    assert sum(out[-500:]) > 420
    xor = [(np.array([0, 1]), np.array([float(a), float(b)]), float(a * b)) for a, b in (rng.integers(0, 2, (3000, 2)) * 2 - 1).tolist()]
    poly = S.StagePolynomial(stage=200, bits=6)
    errors = [(poly.learn(i, v, y, 1.0) - y) ** 2 for i, v, y in xor]
    assert np.mean(errors[-300:]) < 0.3 * np.mean(errors[:200])


def test_graph_labels(spark):
    nodes = spark.createDataFrame([(1, 0), (2, None), (3, None), (4, 1)], "node long, label int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 3)], "a long, b long")
    assert {r["node"]: r["label"] for r in S.graph_labels(nodes, edges).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_masked_actions(spark):
    kept = spark.createDataFrame([(1, 2, 0.7)], "e long, a int, p double")
    every = spark.createDataFrame([(1, 1), (1, 2)], "e long, a int")
    assert {r["a"]: r["p"] for r in S.masked_actions(kept, every, "e", "a").collect()} == {1: 0.0, 2: 0.7}
