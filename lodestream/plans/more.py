"""Further queries: decayed sums, boosting weights, conversions, audits, label spreading, simulations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exploration as X
from ..operators import features, reductions, simulation
from ..sources import examples, sinks
from .data import COSTS_SQL, LOG_SQL, action_costs, log, table
from .queries import _EX_SQL, _events, _examples, query, r


@query(f"""WITH RECURSIVE {LOG_SQL}, o AS (SELECT user_id, event_id, 0.2 / p AS w, cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM log),
s AS (SELECT user_id, k, 1.0::DOUBLE AS n, w::DOUBLE AS sw, (w * cost)::DOUBLE AS swr FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, 0.95::DOUBLE * s.n + 1, 0.95::DOUBLE * s.sw + o.w, 0.95::DOUBLE * s.swr + o.w * o.cost FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id, round(arg_max(n, k), 6) AS n, round(arg_max(sw, k), 6) AS sum_w, round(arg_max(swr, k), 6) AS sum_wr FROM s GROUP BY user_id""")
def dro_tau_fold(spark, sf):
    """Sums over a user's events that fade by 0.95 from each to the next: weights by how many come after."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    rows = log(spark, sf).select("user_id", (0.2 / F.col("p")).alias("w"), "cost", F.pow(F.lit(0.95), F.row_number().over(w) - 1).alias("fade"))
    return rows.groupBy("user_id").agg(r(F.sum("fade")).alias("n"), r(F.sum(F.col("fade") * F.col("w"))).alias("sum_w"), r(F.sum(F.col("fade") * F.col("w") * F.col("cost"))).alias("sum_wr"))


@query(f"""WITH {LOG_SQL}, m AS (SELECT event_id, (k % 5) - 2 AS margin FROM log), q AS (SELECT event_id, CAST(floor((5 - 1 - margin) / 2.0) AS INTEGER) AS j FROM m)
SELECT event_id, round(CASE WHEN j < 0 OR j > 3 THEN 0 ELSE CASE j WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 1 END * pow(0.6, j) * pow(0.4, 3 - j) END::DOUBLE, 6) AS weight FROM q""")
def boosting_weights(spark, sf):
    return log(spark, sf).select("event_id", r(reductions.boosting_weight(1, 5, (F.col("k") % 5) - 2, 0.1)).alias("weight"))


@query(f"WITH {LOG_SQL} SELECT event_id, round(x + x * x + x * x * x, 6) AS total, 4 AS n FROM log")
def autolink_powers(spark, sf):
    f = features.autolink(F.array(features.feature("a", F.lit("bias"), 0.0)), F.col("x"), 3)
    return log(spark, sf).select("event_id", f.alias("f")).select("event_id", r(F.aggregate("f", F.lit(0.0), lambda t, z: t + z["value"])).alias("total"), F.size("f").alias("n"))


@query("""SELECT name, count(*) AS n, round(sum(value), 3) AS total FROM (
SELECT 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size <> 0 UNION ALL SELECT 'p_type=' || p_type, 1.0 FROM part WHERE p_type IS NOT NULL UNION ALL SELECT 'p_brand=' || p_brand, 1.0 FROM part WHERE p_brand IS NOT NULL) GROUP BY name""")
def examples_from_columns(spark, sf):
    ex = examples.from_columns(table(spark, sf, "part"), "p_retailprice", {"p": ["p_size", "p_type", "p_brand"]})
    return features.exploded(ex).groupBy("name").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@query(f"WITH {_EX_SQL} SELECT o_orderkey, ns, name, value, round(value * ascii(ns) / 100.0, 6) AS product FROM f")
def audit_features(spark, sf):
    ex = _examples(spark, sf)
    weights = features.exploded(ex).select("ns", "name").distinct().withColumn("w", F.ascii("ns") / 100.0)
    return sinks.audit(ex, weights, "o_orderkey").select("o_orderkey", "ns", "name", "value", r("product").alias("product"))


@query("""WITH w AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 WHEN turn % 3 = 0 THEN 1 END AS label FROM conversations),
e AS (SELECT conv_id, turn AS a, turn + 1 AS b FROM conversations UNION SELECT conv_id, turn + 1, turn FROM conversations),
v AS (SELECT e.conv_id, e.a AS turn, label, count(*) AS n FROM e JOIN w ON w.conv_id = e.conv_id AND w.turn = e.b WHERE label IS NOT NULL GROUP BY ALL),
best AS (SELECT conv_id, turn, arg_max(label, n * 10 - label) AS vote FROM v GROUP BY ALL)
SELECT w.conv_id, w.turn, coalesce(w.label, vote)::INTEGER AS label FROM w LEFT JOIN best USING (conv_id, turn)""")
def label_spreading(spark, sf):
    c = table(spark, sf, "conversations")
    node = F.col("conv_id") * 1000 + F.col("turn")
    nodes = c.select(node.alias("node"), F.when(F.col("role") == "user", 0).when(F.col("turn") % 3 == 0, 1).alias("label"))
    edges = c.select(node.alias("a"), (node + 1).alias("b"))
    out = simulation.graph_labels(nodes, edges, rounds=1)
    return out.select(F.floor(F.col("node") / 1000).alias("conv_id"), (F.col("node") % 1000).alias("turn"), F.col("label").cast("int").alias("label"))


@query(f"WITH {COSTS_SQL}, k AS (SELECT event_id, j, c FROM costs WHERE c < 0.5) SELECT costs.event_id, CAST(costs.j AS INTEGER) AS j, CASE WHEN k.c IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS p FROM costs LEFT JOIN k ON k.event_id = costs.event_id AND k.j = costs.j")
def masked_actions(spark, sf):
    rows = _events(spark, sf).select("event_id", F.posexplode("costs").alias("j", "c"))
    return simulation.masked_actions(rows.where("c < 0.5").select("event_id", "j", F.lit(0.5).alias("p")), rows.select("event_id", "j"), "event_id", "j").select("event_id", "j", "p")


@query()
def cbify_simulation(spark, sf):
    return simulation.cbify(log(spark, sf).withColumn("costs", action_costs()), "a", F.col("costs"), 0.1, 7, "event_id").select("event_id", "chosen", r("p").alias("p"), "cost")


@query(f"WITH {COSTS_SQL}, s AS (SELECT event_id, j, c, exp(-3 * c) / sum(exp(-3 * c)) OVER (PARTITION BY event_id) AS q FROM costs) SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY q DESC, c, j) - 1 AS INTEGER) AS rank, CAST(j AS INTEGER) AS j FROM s")
def ordered_actions(spark, sf):
    order = X.order_actions(X.softmax(F.col("costs"), -3.0), F.col("costs"))
    return _events(spark, sf).select("event_id", F.posexplode(order).alias("rank", "j"))
