"""Online learners as queries: folds by key. SQL says those of few dense features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batch, composed, features, online
from .data import ACTIONS, LOG_SQL, action_costs, log, table
from .queries import QUERIES, query, r

_ORDERED = f"WITH RECURSIVE {LOG_SQL}, o AS (SELECT user_id, event_id, x, y, cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM log)"


def _stream(spark, sf):
    return log(spark, sf).select("user_id", F.col("event_id").alias("seq"), F.expr("array(0L, 1L)").alias("idx"), F.array(F.col("x"), F.lit(1.0)).alias("val"), "y", F.lit(1.0).alias("weight"))


def _predictions(spark, sf, make, passes=1):
    out = online.train(_stream(spark, sf), online.Run(make, passes), ["user_id"]).where("kind = 'prediction'")
    return out.select(F.col("seq").alias("event_id"), (r("p") + 0.0).alias("p"))


_SLOPE = "(-y / (1 + exp(y * p)))"


@query(f"""{_ORDERED}, s AS (SELECT *, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS p FROM o WHERE n = 1
UNION ALL SELECT o.*, u2, v2, u2 * o.x + v2 FROM (SELECT user_id, n, u - 0.1 * {_SLOPE} * x AS u2, v - 0.1 * {_SLOPE} AS v2 FROM s) b JOIN o ON o.user_id = b.user_id AND o.n = b.n + 1)
SELECT event_id, round(p, 6) + 0.0 AS p FROM s""")
def sgd_fold(spark, sf):
    return _predictions(spark, sf, lambda: online.GD(loss="logistic", rate=0.1, power=0.0, adaptive=False, normalized=False, invariant=False, bits=1))


@query(f"""{_ORDERED}, s AS (SELECT *, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS gu, 0.0::DOUBLE AS gv, 0.0::DOUBLE AS p FROM o WHERE n = 1
UNION ALL SELECT o.*, u2, v2, gu2, gv2, u2 * o.x + v2 FROM (SELECT user_id, n, gu2, gv2, u - 0.5 * sl * x / sqrt(greatest(gu2, 1e-300)) AS u2, v - 0.5 * sl / sqrt(greatest(gv2, 1e-300)) AS v2 FROM
  (SELECT *, gu + sl * sl * greatest(x * x, 1.17549435e-38) AS gu2, gv + sl * sl AS gv2 FROM (SELECT *, {_SLOPE} AS sl FROM s))) b JOIN o ON o.user_id = b.user_id AND o.n = b.n + 1)
SELECT event_id, round(p, 6) + 0.0 AS p FROM s""")
def adagrad_fold(spark, sf):
    return _predictions(spark, sf, lambda: online.GD(loss="logistic", rate=0.5, adaptive=True, normalized=False, invariant=False, bits=1))


_FTRL_W = "CASE WHEN abs({z}) <= 0.1 THEN 0 ELSE -sign({z}) * (abs({z}) - 0.1) / ((1 + sqrt({q})) / 0.5) END"


@query(f"""{_ORDERED}, s AS (SELECT *, 0.0::DOUBLE AS zu, 0.0::DOUBLE AS zv, 0.0::DOUBLE AS qu, 0.0::DOUBLE AS qv, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS p FROM o WHERE n = 1
UNION ALL SELECT o.*, zu2, zv2, qu2, qv2, u2, v2, u2 * o.x + v2 FROM (SELECT *, {_FTRL_W.format(z='zu2', q='qu2')} AS u2, {_FTRL_W.format(z='zv2', q='qv2')} AS v2 FROM (
  SELECT user_id, n, zu + sl * x - (sqrt(qu + sl * sl * x * x) - sqrt(qu)) / 0.5 * u AS zu2, zv + sl - (sqrt(qv + sl * sl) - sqrt(qv)) / 0.5 * v AS zv2, qu + sl * sl * x * x AS qu2, qv + sl * sl AS qv2
  FROM (SELECT *, {_SLOPE} AS sl FROM s))) b JOIN o ON o.user_id = b.user_id AND o.n = b.n + 1)
SELECT event_id, round(p, 6) + 0.0 AS p FROM s""")
def ftrl_fold(spark, sf):
    return _predictions(spark, sf, lambda: online.FTRL(loss="logistic", l1=0.1, bits=1))


for _name, _make, _passes in (
    ("gd_fold", lambda: online.GD(loss="logistic", bits=1), 1),
    ("pistol_fold", lambda: online.Pistol(bits=1), 1),
    ("coin_fold", lambda: online.Coin(bits=1), 1),
    ("freegrad_fold", lambda: online.FreeGrad(bits=1), 1),
    ("svrg_fold", lambda: online.SVRG(bits=1), 4),
    ("nn_fold", lambda: online.NeuralNet(units=3, bits=1), 2),
    ("boosting_fold", lambda: composed.Boosting(learners=3, bits=1), 1),
    ("active_fold", lambda: composed.Active(bits=1), 1),
    ("replay_fold", lambda: composed.Replay(base=online.GD(bits=1), size=8), 1),
    ("baseline_fold", lambda: composed.Baseline(bits=1), 1),
    ("ksvm_fold", lambda: composed.KernelMachine(), 1),
    ("oja_newton_fold", lambda: composed.OjaNewton(size=1, bits=1), 1),
    ("cbzo_fold", lambda: composed.ZerothOrder(bits=1, low=-5, high=5), 1),
):

    @query(name=_name)
    def _fold(spark, sf, make=_make, passes=_passes):
        return _predictions(spark, sf, make, passes)


def _typed(spark, sf):
    """Which event type comes next to a context: a multiclass stream for each user."""
    label = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("event_type")).cast("double")
    return log(spark, sf).select("user_id", F.col("event_id").alias("seq"), F.array((F.col("k") % 16).cast("long"), (16 + F.floor(F.col("value") / 25) % 16).cast("long")).alias("idx"), F.expr("array(1D, 1D)").alias("val"), label.alias("y"), F.lit(1.0).alias("weight"))


for _name, _make, _shift in (
    ("oaa_online", lambda: composed.OneAgainstAll(classes=5, bits=5), 0),
    ("ect_online", lambda: composed.Tournament(classes=5, bits=5), 0),
    ("log_multi_online", lambda: composed.LogTree(classes=5, bits=5), 0),
    ("plt_online", lambda: composed.LabelTree(labels=5, bits=5), 1),
    ("memory_tree_online", lambda: composed.MemoryTree(leaf=8, bits=5), 0),
    ("mf_online", lambda: online.Factors(split=16, bits=5), 0),
):

    @query(name=_name)
    def _multi(spark, sf, make=_make, shift=_shift):
        rows = _typed(spark, sf).withColumn("y", F.col("y") - shift)
        out = online.train(rows, online.Run(make), ["user_id"]).where("kind = 'prediction'")
        return out.select("user_id", F.col("seq").alias("event_id"), r("p").alias("p"))


@query()
def gd_hashed_online(spark, sf):
    """Quality of documents from hashed words: shards by a hash of the id, averaged like a cluster's nodes."""
    words = table(spark, sf, "documents").select("doc_id", features.constant(features.bag_of("t", F.array_distinct(T.tokens(F.col("text"))))).alias("features"))
    rows = online.hashed(words.join(table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2.0 - 1).alias("y")), "doc_id"), "features", bits=16)
    shards = max(4, -(-rows.count() // 50_000))  # an example's features are held in its shard's task
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.col("doc_id").alias("seq"), "idx", "val", "y", F.lit(1.0).alias("weight"))
    out = online.train(rows, online.Run(lambda: online.GD(loss="logistic", bits=16), passes=2), ["shard"]).where("kind = 'weight'")
    models = out.select(F.col("shard").alias("model"), F.lit("").alias("ns"), F.col("idx").cast("string").alias("name"), "w", F.col("state").alias("adapt"), F.lit(1).alias("examples"))
    return batch.merge(models.where("adapt > 0"), state="adapt").select(F.col("name").cast("long").alias("idx"), "w")


def _bandit(spark, sf, run, schema):
    ev = log(spark, sf).select("user_id", "event_id", "k", "a", "cost", "p", action_costs().alias("costs"))

    def fold(rows: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(run(sorted(rows.to_pylist(), key=lambda x: x["event_id"])), schema=pa.schema(schema))

    return ev.groupBy("user_id").applyInArrow(fold, ", ".join(f"{n} {'long' if t == pa.int64() else 'double'}" for n, t in schema))


def _actions(row, n=5):
    return [(np.array([j, 8 + row["k"] % 8, 16 + j * 8 + row["k"] % 8], np.int64), np.array([1.0, 0.5, 1.0])) for j in range(n)]


for _name, _kw in {"cb_adf_mtr": {}, "cb_adf_dr_softmax": {"estimator": "dr", "explore": "softmax"}, "cb_adf_ips_squarecb": {"estimator": "ips", "explore": "squarecb"}, "cb_adf_bag": {"explore": "bag"}, "cb_adf_cover": {"explore": "cover"}, "cb_adf_dm_first": {"estimator": "dm", "explore": "first"}}.items():

    @query(name=_name)
    def _cb(spark, sf, kw=_kw):
        def run(rows):
            policy = composed.Policy(bits=6, **kw)
            return [{"event_id": x["event_id"], "p": round(float(policy.learn(_actions(x), x["a"], x["cost"], x["p"])[x["a"]]), 6)} for x in rows]

        return _bandit(spark, sf, run, [("event_id", pa.int64()), ("p", pa.float64())])


@query()
def ccb_online(spark, sf):
    """Two slots an event: what the first slot takes is gone for the second."""

    def run(rows):
        policy, out = composed.Policy(bits=6), []
        slots = [(np.array([60 + s], np.int64), np.ones(1)) for s in range(2)]
        for x in rows:
            for s, (_, p, best) in enumerate(policy.slots(_actions(x), slots)):
                out.append({"event_id": x["event_id"], "slot": s, "action": best, "p": round(float(p.max()), 6)})
            policy.learn(_actions(x), x["a"], x["cost"], x["p"])
        return out

    return _bandit(spark, sf, run, [("event_id", pa.int64()), ("slot", pa.int64()), ("action", pa.int64()), ("p", pa.float64())])


@query()
def slates_online(spark, sf):
    """Two slots with pools of their own, learnt from the event's one cost."""

    def run(rows):
        policy, out = composed.Policy(bits=6), []
        slots = [(np.array([60 + s], np.int64), np.ones(1)) for s in range(2)]
        for x in rows:
            chosen = policy.slots(_actions(x), slots, pools=[[0, 1, 2], [3, 4]])
            out += [{"event_id": x["event_id"], "slot": s, "action": best, "p": round(float(p.max()), 6)} for s, (_, p, best) in enumerate(chosen)]
            policy.learn(_actions(x), x["a"], x["cost"], x["p"])
        return out

    return _bandit(spark, sf, run, [("event_id", pa.int64()), ("slot", pa.int64()), ("action", pa.int64()), ("p", pa.float64())])


@query()
def automl_champion(spark, sf):
    def run(rows):
        race = composed.ChampionRace([composed.Policy(bits=6, explore=e) for e in ("epsilon", "softmax", "squarecb")], least=20)
        return [{"event_id": x["event_id"], "champion": race.learn(_actions(x), x["a"], x["cost"], x["p"])} for x in rows]

    return _bandit(spark, sf, run, [("event_id", pa.int64()), ("champion", pa.int64())])


@query()
def cats_tree_online(spark, sf):
    def run(rows):
        tree, out = composed.CatsTree(bins=8, bits=6), []
        for x in rows:
            p = tree.learn_logged(np.array([x["k"] % 16], np.int64), np.ones(1), x["k"] / 100, x["cost"], x["p"])
            out.append({"event_id": x["event_id"], "p": round(p, 6)})
        return out

    return _bandit(spark, sf, run, [("event_id", pa.int64()), ("p", pa.float64())])


@query()
def large_action_space(spark, sf):
    """Actions of an event pruned to a spanner of their feature vectors."""

    def run(rows):
        out = []
        for x in rows:
            v = np.array([[c, c * c, 1.0] for c in x["costs"]])
            out += [{"event_id": x["event_id"], "action": int(a)} for a in composed.spanner(v, 3)]
        return out

    return _bandit(spark, sf, run, [("event_id", pa.int64()), ("action", pa.int64())])


@query()
def search_sequence(spark, sf):
    """Roles of conversation turns as sequences, labelled by learning to search; one policy for each of 8 groups."""
    roles = ("assistant", "system", "user")
    turns = table(spark, sf, "conversations")
    groups = max(8, -(-turns.count() // 20_000))
    c = turns.select(F.pmod(F.xxhash64("conv_id"), F.lit(groups)).cast("int").alias("g"), "conv_id", "turn", "role", T.tokens(F.col("text")).alias("w"))

    def fold(rows: pa.Table) -> pa.Table:
        from ..functions.hashing import murmur3_many

        model, out, by = composed.Sequences(3, bits=12), [], {}
        for x in sorted(rows.to_pylist(), key=lambda x: (x["conv_id"], x["turn"])):
            by.setdefault(x["conv_id"], []).append(x)
        for conv, turns in by.items():
            steps = [(i, np.ones(len(i))) for i in (np.unique(murmur3_many([w.encode() for w in x["w"]]) & np.uint64(4095)).astype(np.int64) for x in turns)]
            labels = model.learn(steps, [roles.index(x["role"]) if x["role"] in roles else 2 for x in turns])
            out += [{"conv_id": conv, "turn": x["turn"], "predicted": roles[k]} for x, k in zip(turns, labels, strict=True)]
        return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("predicted", pa.string())]))

    return c.groupBy("g").applyInArrow(fold, "conv_id long, turn long, predicted string")


@query()
def lda_topics(spark, sf):
    """Topics of each source's documents by online variational inference, one model a source, or a
    shard of one where a source is large."""
    docs = table(spark, sf, "documents")
    sizes = docs.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / 20_000).alias("shards"))
    d = docs.join(F.broadcast(sizes), F.col("source").eqNullSafe(F.col("s"))).select("source", F.pmod(F.xxhash64("doc_id"), F.col("shards")).alias("shard"), "doc_id", T.tokens(F.col("text")).alias("w"))

    def fold(rows: pa.Table) -> pa.Table:
        from ..functions.hashing import murmur3_many

        docs, ids = [], []
        for x in sorted(rows.to_pylist(), key=lambda x: x["doc_id"]):
            h, n = np.unique(murmur3_many([w.encode() for w in x["w"]]) & np.uint64(1023), return_counts=True)
            docs.append((h.astype(np.int64), n.astype(float)))
            ids.append(x["doc_id"])
        _, theta = composed.lda(docs, 4, 1024)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "topic": pa.array(theta.argmax(1), pa.int64()), "share": pa.array(np.round(theta.max(1), 6))})

    return d.groupBy("source", "shard").applyInArrow(fold, "doc_id long, topic long, share double")


__all__ = ["QUERIES"]
