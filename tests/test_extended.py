"""Learners beyond the registered queries, known outcomes, and stacks that refuse what they can't use."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import asking, composed, events, factors, features, online, searching, trees
from lodestream.plans.stack import Stack
from lodestream.sources import sinks

rng = np.random.default_rng(5)


def words(*names):
    """Features by name, numbered by first use."""
    return np.array([ids.setdefault(n, len(ids)) for n in names], np.int64), np.ones(len(names))


ids: dict = {}


def test_known_loss_of_three_bandit_events():
    """Two labelled events of three: losses of 2/3 (uniform over three actions, cost 1 at probability 1/2) and 0."""
    policy = composed.Policy(epsilon=0.05, bits=7)
    shared = ("s1", "s2")
    first = [words(*a, *shared) for a in (("a1", "b1", "c1"), ("a2", "b2", "c2"), ("a3", "b3", "c3"))]
    p1 = policy.learn(first, 0, 1.0, 0.5)
    second = [words("b1", "c1", "d1"), words("b2", "c2", "d2")]
    p2 = policy.learn(second, 1, 0.0, 0.5)
    loss = (p1[0] * 1.0 / 0.5 + p2[1] * 0.0 / 0.5) / 2
    assert loss == pytest.approx(0.333333, abs=1e-6) and p2[1] == pytest.approx(0.975)


def test_known_loss_of_slates():
    """The pseudo-inverse estimate of two equal events of cost 0.8: 0.2 from a uniform policy, then -0.75."""
    policy, losses = composed.Policy(epsilon=0.05, bits=7), []
    for _ in range(2):
        actions = [words(f"action{k}", "sh0", "sh1") for k in range(5)]
        slots = [words("slot0"), words("slot1")]
        pools = [[0, 1, 2], [3, 4]]
        got = events.learn_slots(policy, actions, slots, [{"action": 1, "cost": 0.8, "p": 0.8}, {"action": 3, "cost": 0.8, "p": 0.6}], pools)
        q = got[0][2][1], got[1][2][0]
        losses.append(0.8 * (q[0] / 0.8 + q[1] / 0.6 - 1))
    assert losses == pytest.approx([0.2, -0.75]) and np.mean(losses) == pytest.approx(-0.275)


def stream(n, classes, noise=0.0):
    for _ in range(n):
        k = int(rng.integers(classes))
        idx = np.unique(np.concatenate([[k], classes + rng.integers(0, 6, 2)]))
        yield idx, np.ones(len(idx)), float(k + 1 if rng.random() >= noise else rng.integers(classes) + 1)


@pytest.mark.parametrize(
    ("make", "least"),
    [
        (lambda: trees.RecallTree(classes=8, bits=5), 0.8),
        (lambda: trees.EigenMemoryTree(leaf=20, bits=5), 0.8),
        (lambda: trees.EigenMemoryTree(leaf=20, capacity=60, bits=5), 0.5),
        (lambda: composed.MemoryTree(leaf=20, bits=5), 0.5),
    ],
)
def test_log_time_learners(make, least):
    model, right = make(), []
    for idx, val, y in stream(800, 8):
        right.append(model.predict(idx, val) == y)
        model.learn(idx, val, y, 1.0)
    assert np.mean(right[400:]) >= least
    at, w, _ = model.rows()
    assert len(at) == len(w) > 0


def test_bounded_memories():
    model = trees.EigenMemoryTree(leaf=10, capacity=30, bits=5)
    for idx, val, y in stream(200, 8):
        model.learn(idx, val, y, 1.0)
    kept, queue = 0, [model.root]
    for node in queue:
        kept += len(node["memories"])
        queue += node["kids"] or ()
        assert all(model.used[k][0] is node for k in node["memories"])
    assert kept == len(model.used) == 30
    free = composed.MemoryTree(leaf=10, bits=5)
    for idx, val, y in stream(200, 8):
        free.learn(idx, val, y, 1.0)
    assert len(free.memories()) == 200


def test_recall_bound_and_entropy():
    node = trees._Node(counts=trees.Counter({1: 90.0, 2: 10.0}), n=100.0)
    tree = trees.RecallTree(classes=8, candidates=1, bits=3)
    assert tree.offered(node) == [1] and tree.recall(node) == pytest.approx(0.9 - 0.03 - 15 / (np.sqrt(18) * 100))
    assert tree._added(node, 1, 1.0) < tree._added(node, 2, 1.0)


def test_learners_that_ask():
    sure = asking.Confidence(bits=3)
    cover = asking.ActiveCover(cover=4, bits=3, mellowness=0.01)
    ranges, sparing = asking.CostRanges(classes=2, bits=3, c0=0.001), asking.CostRanges(classes=2, bits=3, c0=0.001, c1=10.0)
    early = late = 0
    for n in range(600):
        x = rng.normal()
        idx, val, y = np.array([0, 1]), np.array([x, 1.0]), 1.0 if x > 0 else -1.0
        grown = sure.learn(idx, val, y, 1.0)
        before = cover.asked
        cover.learn(idx, val, y, 1.0)
        ranges.learn(idx, val, [0.0, 1.0] if x > 0 else [1.0, 0.0], 1.0)
        sparing.learn(idx, val, [0.0, 1.0] if x > 0 else [1.0, 0.0], 1.0)
        asked = cover.asked - before
        early, late = (early + asked, late) if n < 200 else (early, late + asked * (n >= 400))
    assert grown >= 0 and late < early and 0 < sparing.asked < ranges.asked <= 1200
    right = [np.sign(cover.predict(np.array([0, 1]), np.array([x, 1.0]))) == np.sign(x) for x in (-2, -1, 1, 2)]
    assert all(right)
    assert [ranges.predict(np.array([0, 1]), np.array([x, 1.0])) for x in (2.0, -2.0)] == [1.0, 2.0]
    (p, low, high) = ranges.ranges(np.array([0, 1]), np.array([1.0, 1.0]))[0]
    assert 0 <= low <= p <= high <= 1


def test_offset_tree_paths():
    inner, paths = events.paired_tree(5)
    assert inner == [(0, 1), (2, 3), (5, 6), (7, 4)]
    assert paths == [[(0, 0), (2, 0), (3, 0)], [(0, 1), (2, 0), (3, 0)], [(1, 0), (2, 1), (3, 0)], [(1, 1), (2, 1), (3, 0)], [(3, 1)]]
    tree, idx, val = events.OffsetTree(5, bits=3), np.array([0]), np.ones(1)
    for _ in range(300):
        a = int(rng.integers(5))
        tree.learn(idx, val, a, float(a != 3), 0.2)
    p = tree.distribution(idx, val)
    assert p.sum() == pytest.approx(1) and p.argmax() == 3


def test_factors_learn_products():
    for make in (lambda: factors.SplitFactors(rank=2, split=8, bits=4), lambda: factors.FieldFactors(bounds=(8,), rank=2, bits=4)):
        model, truth, errors = make(), rng.normal(size=(8, 8)), []
        truth = np.outer(truth[0], truth[1])
        for _ in range(6000):
            i, j = int(rng.integers(8)), int(rng.integers(8))
            p = model.learn(np.array([i, 8 + j]), np.ones(2), truth[i, j], 1.0)
            errors.append((p - truth[i, j]) ** 2)
        assert np.mean(errors[-500:]) < 0.2 * np.mean(errors[:500])


def test_search_tasks():
    search = searching.Searcher(2, bits=10)
    data = [(np.array([k, 20 + int(rng.integers(3))]), np.ones(2), k) for k in list(range(6)) * 30]
    losses = [search.learn(searching.multiclass_task(*x, 6, 10)) for x in data]
    assert np.mean(losses[-30:]) < 0.2
    task = searching.multiclass_task(*data[0], 6, 10)
    assert search.run(task) == 0.0 and search.branch(task, most=3)[1] == 0.0
    er = searching.Searcher(2 + 3, bits=10)
    allowed = lambda a, b: [0, 1] if a != b else [0, 2]
    made = []
    for _ in range(200):
        t = [int(rng.integers(2)) for _ in range(2)]
        kind = 1 if t[0] != t[1] else 2
        made.append(searching.entity_relation_task([(np.array([x]), np.ones(1), x) for x in t], [(0, 1, np.array([5]), np.ones(1), kind)], 2, 3, allowed, 10))
    losses = [er.learn(x) for x in made]
    assert np.mean(losses[-50:]) < 0.1


def test_stack_uses_or_refuses(spark):
    for bad in ("--oaa 3 --bag 4", "--csoaa_ldf --epsilon 0.1", "--cb_explore_adf --passes 3", "--ftrl --power_t 0.3", "--OjaNewton -b 18"):
        stack = Stack.parse(bad)
        with pytest.raises(ValueError):
            if stack.layers and stack.layers[0][0].startswith(("cs", "cb")):
                f = F.array(features.feature("a", F.lit("x")))
                stack.fit_events(spark.range(1).select(F.lit(1).alias("g"), F.col("id").alias("seq"), f.alias("shared"), F.array(f).alias("actions"), F.lit(0).alias("chosen"), F.lit(1.0).alias("cost"), F.lit(1.0).alias("p"), F.array(F.lit(1.0)).alias("costs")), ["g"])
            else:
                stack.fit(spark.range(1).select(F.lit(1).alias("g"), F.col("id").alias("seq"), F.array(features.feature("a", F.lit("x"))).alias("features"), F.lit(1.0).alias("y"), F.lit(1.0).alias("weight")), ["g"])


def test_stacks_fit(spark):
    rows = [(k % 2, k, 1.0 if k % 3 else -1.0, 1.0, ["a" if k % 3 else "b", "c"]) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, seq long, y double, weight double, w array<string>").withColumn("features", features.bag_of("t", F.col("w"))).drop("w")
    for options in ("--bfgs --loss_function logistic --passes 4 --l2 1 -b 10", "--ftrl --loss_function logistic -b 10 --ngram t2 --affix +1t --spelling t", "--bootstrap 3 -b 8", "--binary -b 8 --classweight 1:2,-1:1", "--nn 2 -b 8 --random_seed 3", "--active --mellowness 4 -b 8 --link logistic", "--coin --passes 3 --save_per_pass --holdout_after 25 -b 8"):
        model = Stack.parse(options).fit(df, ["g"])
        assert model.weights.count() > 0
    scores = {r["seq"]: r["score"] for r in Stack.parse("--bfgs --loss_function logistic --passes 6 --l2 0.1 -b 10").fit(df, ["g"]).transform(df, "seq").collect()}
    assert scores[1] > 0 > scores[0]
    f = lambda *n: F.array(*[features.feature("x", F.lit(v)) for v in n])
    ev = df.select("g", "seq", f("s").alias("shared"), F.array(f("p"), f("q")).alias("actions"), (F.col("seq") % 2).cast("int").alias("chosen"), (F.col("seq") % 2).cast("double").alias("cost"), F.lit(0.5).alias("p"), F.array(F.lit(0.0), F.lit(1.0)).alias("costs"))
    slots = ev.select("g", "seq", "shared", "actions", F.array(f("one"), f("two")).alias("slots"), F.array(*[F.struct(F.lit(k).alias("action"), F.lit(float(k)).alias("cost"), F.lit(0.5).alias("p")) for k in (0, 1)]).alias("outcomes"), F.array(F.array(F.lit(0)), F.array(F.lit(1))).alias("pools"))
    for options, data in (("--cb_explore_adf --bag 3 -b 8", ev), ("--cb_explore_adf --cover 3 --psi 0.5 -b 8 -q xx", ev), ("--cb_adf --cb_type dr --clip_p 0.1 -b 8", ev), ("--cb_explore 2 --epsilon 0.2 -b 8", ev), ("--ot 2 -b 8", ev), ("--wap_ldf -b 8", ev), ("--ccb_explore_adf -b 8", slots), ("--slates --epsilon 0.1 -b 8", slots)):
        out = Stack.parse(options).fit_events(data, ["g"]).collect()
        assert len(out) == (120 if "slots" in data.columns else 60) and all(abs(sum(r["pmf"]) - 1) < 1e-9 for r in out)


def test_multilabels_and_hexadecimal_models(spark):
    df = spark.createDataFrame([(0, k, [k % 2 + 1], 1.0, ["ab"[k % 2]]) for k in range(40)], "g int, seq long, y array<int>, weight double, w array<string>").withColumn("features", features.bag_of("t", F.col("w")))
    out = Stack.parse("--multilabel_oaa 2 -b 8").fit(df, ["g"]).predictions.orderBy("seq").collect()
    assert [r["p"] for r in out[-2:]] == [1.0, 2.0]
    w = spark.createDataFrame([(1, 0.1), (2, -3.0)], "idx long, w double")
    lines = [r["value"].split(":") for r in sinks.readable_model(w, hexadecimal=True).collect()]
    assert [(i, float.fromhex(x)) for i, x in lines] == [("1", 0.1), ("2", -3.0)]


def test_aliases_of_losses():
    assert online.GD(loss="pinball", bits=1).loss == "quantile" and online.GD(loss="classic", bits=1).loss == "squared"
    for p, y in ((0.2, 1.0), (1.5, 1.0)):
        e = 1e-5
        slope = (online.loss_value("expectile", p + e, y, 0.3) - online.loss_value("expectile", p - e, y, 0.3)) / (2 * e)
        assert slope == pytest.approx(online.loss_slope("expectile", p, y, 0.3), rel=1e-4)


def test_multiclass_estimator(spark):
    from lodestream.api import MulticlassClassifier

    rows = [(k, "xyz"[k % 3], "abc"[k % 3]) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, f string, label string")
    model = MulticlassClassifier("-b 10", namespaces={"n": ["f"]}, shards=1, order="id").fit(df)
    out = model.transform(df, "id").collect()
    assert all(r["prediction"] == r["label"] and len(r["scores"]) == 3 for r in out)


def test_search_for_interactions():
    """A reward that only the product of two namespaces tells."""
    search = events.InteractionSearch(lambda: composed.Policy(bits=10, epsilon=0.1), ["a", "u"], challengers=3, lease=300, bits=10)
    for _ in range(2500):
        u = int(rng.integers(2))
        actions = [{"a": (np.array([k]), np.ones(1)), "u": (np.array([10 + u]), np.ones(1))} for k in range(2)]
        chosen = int(rng.integers(2))
        search.learn(actions, chosen, float(chosen != u), 0.5)
    assert ("a", "u") in search.champion
    pmf = search.live[search.champion][0].distribution([search.expand(a, search.champion) for a in actions])
    assert int(np.argmax(pmf)) == u
    i, v = search.expand({"a": (np.array([1, 2]), np.array([2.0, 3.0])), "u": (np.array([5]), np.array([4.0]))}, {("a", "u")})
    assert v.tolist() == [2.0, 3.0, 4.0, 8.0, 12.0]


def test_epsilon_decay():
    decay, last = events.EpsilonDecay(lambda: composed.Policy(bits=4), models=2), None
    for _ in range(400):
        chosen = int(rng.integers(2))
        last = decay.learn([(np.array([k]), np.ones(1)) for k in range(2)], chosen, float(chosen), 0.5)
    assert last[0] > 0.8 and last.sum() == pytest.approx(1)


def test_streamed_learners_go_on(spark, tmp_path):
    """Two micro-batches give what one fold gives."""
    from lodestream.streaming import progressive

    rows = [(k % 2, k, [0, 1], [float(rng.normal()), 1.0], 1.0 if k % 3 else -1.0, 1.0) for k in range(80)]
    schema = "u int, n long, idx array<long>, val array<double>, y double, weight double"
    for part, some in enumerate((rows[:50], rows[50:])):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = progressive.learn_by_key(stream, "u", "n", lambda: online.GD(loss="logistic", bits=1))
    query = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["n"]: r["prediction"] for r in spark.table("streamed").collect()}
    for u in (0, 1):
        model = online.GD(loss="logistic", bits=1)
        for v, n, i, x, y, w in rows:
            if v == u:
                assert got[n] == pytest.approx(model.learn(np.array(i), np.array(x), y, w))


def test_values_by_event_time(spark, tmp_path):
    from lodestream.streaming import progressive

    rows = [(f"2024-01-01 0{h}:{m:02d}:00", float(h), 2.0) for h in range(3) for m in (5, 35)]
    df = spark.createDataFrame(rows, "ts string, cost double, ratio double").select(F.to_timestamp("ts").alias("ts"), "cost", "ratio")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = progressive.windowed_value(stream, "ts", "cost", "ratio")
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["n"], r["ips"]) for r in spark.table("windows").collect()) == [(2, 0.0), (2, 2.0), (2, 4.0)]


def test_a_prior_holds_weights(spark):
    from lodestream.operators import batch

    rows = [(k, 1.0 if k % 3 else -1.0, 1.0, "a", "x", 1.0) for k in range(60)]
    ex = spark.createDataFrame(rows, "id long, y double, weight double, ns string, name string, value double")
    free = batch.lbfgs(ex, passes=6)[0].first()["w"]
    prior = spark.createDataFrame([("a", "x", -2.0, 1e4)], "ns string, name string, w0 double, strength double")
    held = batch.lbfgs(ex, passes=6, prior=prior)[0].first()["w"]
    assert free > 0.5 and abs(held + 2) < 0.05
    own = batch.prior_of(ex, spark.createDataFrame([("a", "x", 0.5)], "ns string, name string, w double")).first()
    assert own["w0"] == 0.5 and own["strength"] > 0
