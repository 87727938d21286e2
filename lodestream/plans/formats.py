"""Readers, writers, hashing and feature options against SQL: what the formats say is derived a second time."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import batch, features, online
from ..sources import examples as S
from ..sources import sinks
from .data import ACTIONS, COSTS_SQL, LOG_SQL, action_costs, log, table
from .folds import D0, fold_sql, lets, register
from .learning import _stream
from .queries import ORACLE_SQL, query, r
from .stack import Stack, fit_many

# --- examples from text, JSON, decision logs, CSV -------------------------------------------------


def _features(df, *keys, column="features"):
    return df.select(*keys, F.explode(column).alias("f")).select(*keys, "f.ns", "f.name", r("f.value").alias("value"))


_TEXT = "SELECT event_id, y AS label_value, p AS weight, 'e' || event_id AS tag, {} FROM log{}"


@query(f"WITH {LOG_SQL} " + " UNION ALL ".join(_TEXT.format(*x) for x in (("'u' AS ns, 'k' AS name, CAST(k AS DOUBLE) AS value", " WHERE k <> 0"), ("'u', event_type, 1.0::DOUBLE", ""), ("'v', 'val', round(2 * value, 6)", " WHERE value <> 0"), ("'v', '0', 4.0::DOUBLE", ""))))
def text_lines_parsed(spark, sf):
    line = F.concat(F.col("y"), F.lit(" "), F.col("p"), F.lit(" 'e"), F.col("event_id"), F.lit("|u k:"), F.col("k"), F.lit(" "), F.col("event_type"), F.lit(" |v:2 val:"), F.col("value"), F.lit(" :2 none:0"))
    parsed = S.parse_lines(log(spark, sf).select("event_id", line.alias("line")), "line", strict=True)
    return _features(parsed, "event_id", "label_value", "weight", "tag")


@query(f"WITH {LOG_SQL} SELECT event_id, k % 3 = 0 AS malformed, CASE WHEN k % 3 = 0 THEN 1.0::DOUBLE ELSE 3.5::DOUBLE END AS total FROM log")
def malformed_numbers(spark, sf):
    line = F.concat(F.lit("1 |f a:"), F.when(F.col("k") % 3 == 0, "1x").otherwise("2.5"), F.lit(" b"))
    parsed = S.parse_lines(log(spark, sf).select("event_id", line.alias("line")), "line")
    return parsed.select("event_id", F.col("corrupt").isNotNull().alias("malformed"), F.aggregate("features", F.lit(0.0), lambda t, f: t + f["value"]).alias("total"))


@query(f"WITH {LOG_SQL} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_of_user, CAST(a AS INTEGER) AS action, round(cost, 6) AS cost, p, k % 5 || ',' || (k % 5 + 1) AS labels FROM log")
def multi_line_events(spark, sf):
    """Three lines an event, the last blank; labels of actions and lists of labels read from their text."""
    e = log(spark, sf)
    label = F.concat_ws(":", F.col("a"), F.round("cost", 6), F.col("p"))
    text = F.array(F.concat(F.lit("shared | k:"), F.col("k")), F.concat(label, F.lit(" | x"), F.col("event_id")), F.lit("  "))
    lines = e.select("user_id", F.col("event_id").alias("e"), F.concat_ws(",", F.col("k") % 5, F.col("k") % 5 + 1).alias("m"), F.posexplode(text).alias("at", "line")).withColumn("n", F.col("e") * 3 + F.col("at"))
    got = S.parse_lines(S.with_events(lines, "n", "line", "user_id").select("e", "event_id", "m", "line"), "line")
    one = S.cost_labels(F.col("label"))[0]
    return got.where("kind = 'action'").select(F.col("e").alias("event_id"), F.col("event_id").alias("event_of_user"), one["action"].alias("action"), one["cost"].alias("cost"), one["p"].alias("p"), F.array_join(S.multilabels(F.col("m")).cast("array<string>"), ",").alias("labels"))


_JSON_ROWS = (("'u' AS ns, 'k' AS name, CAST(k AS DOUBLE) AS value", " WHERE k <> 0"), ("'u', 'kind=' || event_type, 1.0::DOUBLE", ""), ("'', 'big', 1.0::DOUBLE", " WHERE value > 50"), ("'', 'one', 1.0::DOUBLE", ""), ("'', 'two_', 1.0::DOUBLE", ""), ("'l', '1', 2.0::DOUBLE", ""))


@query(f"WITH {LOG_SQL} " + " UNION ALL ".join(f"SELECT event_id, y AS label, p AS weight, 't' || event_id AS tag, {x} FROM log{w}" for x, w in _JSON_ROWS))
def json_examples(spark, sf):
    text = F.concat(F.lit('{"_label":{"Label":'), F.col("y"), F.lit(',"Weight":'), F.col("p"), F.lit('},"_tag":"t'), F.col("event_id"), F.lit('","u":{"k":'), F.col("k"), F.lit(',"kind":"'), F.col("event_type"), F.lit('"},"big":'), (F.col("value") > 50).cast("string"), F.lit(',"_text":"one  two:","l":[0,2]}'))
    return _features(S.parse_json(log(spark, sf).select("event_id", text.alias("j")), "j"), "event_id", "label", "weight", "tag", column="shared")


@query(f"WITH {LOG_SQL} SELECT event_id, k % 3 AS n_slots, CASE WHEN k % 3 > 0 THEN '0,2' ELSE '' END AS include, '0,1,' || (k % 2) AS slot_ids, CAST(3 + CASE WHEN k > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_features FROM log")
def slates_json(spark, sf):
    """Slots with the actions they may take, and actions with the slot that they belong to."""
    slot = F.lit('{"_id":"s","_inc":[0,2],"f":{"a":1}}')
    action = lambda j: F.concat(F.lit('{"_slot_id":'), j, F.lit(',"x":{"j":1}}'))
    text = F.concat(F.lit('{"_label_cost":1,"s":{"k":'), F.col("k"), F.lit('},"_multi":['), F.concat_ws(",", action(F.lit("0")), action(F.lit("1")), action((F.col("k") % 2).cast("string"))), F.lit('],"_slots":['), F.array_join(F.array_repeat(slot, F.col("k") % 3), ","), F.lit("]}"))
    p = S.parse_json(log(spark, sf).select("event_id", text.alias("j")), "j")
    include = F.coalesce(F.array_join(F.get("slots", F.lit(0))["include"].cast("array<string>"), ","), F.lit(""))
    n = F.size("shared") + F.aggregate("actions", F.lit(0), lambda t, a: t + F.size(a))
    return p.select("event_id", F.size("slots").cast("long").alias("n_slots"), include.alias("include"), F.array_join(F.col("slot_ids").cast("array<string>"), ",").alias("slot_ids"), n.alias("n_features"))


@query(f"""WITH {LOG_SQL} SELECT 'e' || event_id AS event_id, round(cost, 6) AS cost, p AS probability, CAST(a AS INTEGER) AS chosen, CASE WHEN k % 4 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, k % 7 = 0 AS skip_learn,
  round(0.25::DOUBLE + p, 6) AS listed, CAST(k AS DOUBLE) AS shared, 3.0::DOUBLE AS own FROM log""")
def decision_log(spark, sf):
    """Logged decisions: the weight that dropped events leave, events marked to be skipped, an ignored feature."""
    text = F.concat(
        F.lit('{"EventId":"e'), F.col("event_id"), F.lit('","_label_cost":'), F.round("cost", 6).cast("decimal(20,6)"), F.lit(',"_label_probability":'), F.col("p"), F.lit(',"_label_Action":'), F.col("a") + 1, F.lit(',"_labelIndex":'), F.col("a"), F.lit(',"_skipLearn":'), (F.col("k") % 7 == 0).cast("string"),
        F.lit(',"pdrop":'), F.when(F.col("k") % 4 == 0, 0.5).otherwise(0.0), F.lit(',"a":[1,2],"p":[0.25,'), F.col("p"), F.lit('],"c":{"s":{"k":'), F.col("k"), F.lit(',"z":9},"_multi":[{"x":{"j":1}},{"x":{"j":2}}]}}'),
    )
    d = S.decision_actions(S.parse_decisions(log(spark, sf).select(text.alias("j")), "j"), ignore=("s|z",))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, f: t + f["value"])
    listed = F.aggregate("distribution", F.lit(0.0), lambda t, x: t + x["p"])
    return d.select("event_id", "cost", "probability", "chosen", "weight", "skip_learn", r(listed).alias("listed"), total("shared").alias("shared"), total(F.flatten("actions")).alias("own"))


_CSV_ROWS = (("'a' AS ns, 'k' AS name, CAST(10 * k AS DOUBLE) AS value", " WHERE k <> 0"), ("'b', 'w=say \"' || event_type || '\"', 1.0::DOUBLE", ""), ("'', 'z', round(value, 6)", " WHERE value <> 0"))


@query(f"WITH {LOG_SQL} " + " UNION ALL ".join(f"SELECT event_id, y AS label_value, 't' || event_id AS tag, {x} FROM log{w}" for x, w in _CSV_ROWS))
def csv_lines(spark, sf):
    line = F.concat(F.col("y"), F.lit(";t"), F.col("event_id"), F.lit(";"), F.col("k"), F.lit(';"say ""'), F.col("event_type"), F.lit('""";'), F.col("value"))
    ex = S.parse_csv(log(spark, sf).select("event_id", line.alias("line")), "line", ["_label", "_tag", "a|k", "b|w", "z"], separator=";", scales={"a": 10.0})
    return _features(ex, "event_id", "label_value", "tag")


@query(f"WITH {LOG_SQL} SELECT event_id, y FROM log ORDER BY event_id LIMIT 500")
def first_examples(spark, sf):
    return S.first_examples(log(spark, sf).select("event_id", "y"), "event_id", 500)


@query(f"WITH {LOG_SQL} SELECT event_id, 'u' AS ns, event_type AS name, x AS value FROM log WHERE x <> 0")
def cached_examples(spark, sf):
    """Parsed examples written once as Parquet and read again."""
    ex = log(spark, sf).select("event_id", features.drop_zeros(F.array(features.feature("u", F.col("event_type"), F.col("x")))).alias("features"))
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    back = S.cached(ex, f"{at.rstrip('/')}/examples-{uuid.uuid4().hex}")
    return back.select("event_id", F.explode("features").alias("f")).select("event_id", "f.ns", "f.name", "f.value")


# --- hashing --------------------------------------------------------------------------------------

_M32 = "4294967295::UBIGINT"


def murmur_levels(out: str, text: str, seed: str) -> list[dict[str, str]]:
    """Levels for the 32-bit murmur3 hash of an ASCII text."""
    rotated = lambda x, n: f"((({x} << {n}) | ({x} >> {32 - n})) & {_M32})"
    mixed = lambda k: f"(({rotated(f'(({k} * 3432918353::UBIGINT) & {_M32})', 15)} * 461845907::UBIGINT) & {_M32})"
    turned = rotated("xor(h, k)", 13)
    b = f"{out}_b"
    return [
        {b: f"[CAST(unicode(c) AS UBIGINT) FOR c IN string_split({text}, '')]"},
        {f"{out}_k": f"[{b}[4 * i + 1] + {b}[4 * i + 2] * 256 + {b}[4 * i + 3] * 65536 + {b}[4 * i + 4] * 16777216 FOR i IN range(len({b}) // 4)]",
         f"{out}_t": f"list_sum([CAST({b}[len({b}) // 4 * 4 + i + 1] * pow(256, i) AS UBIGINT) FOR i IN range(len({b}) % 4)])"},
        {f"{out}_m": f"[CAST({mixed('k')} AS UBIGINT) FOR k IN {out}_k]", f"{out}_u": f"CASE WHEN len({b}) % 4 > 0 THEN {mixed(f'CAST({out}_t AS UBIGINT)')} ELSE 0::UBIGINT END"},
        {f"{out}_h": f"list_reduce({out}_m, lambda h, k: CAST(({turned} * 5 + 3864292196::UBIGINT) & {_M32} AS UBIGINT), CAST({seed} AS UBIGINT))"},
        {f"{out}_x": f"xor(xor({out}_h, {out}_u), CAST(len({b}) AS UBIGINT))"},
        {f"{out}_y": f"(xor({out}_x, {out}_x >> 16) * 2246822507::UBIGINT) & {_M32}"},
        {f"{out}_z": f"(xor({out}_y, {out}_y >> 13) * 3266489909::UBIGINT) & {_M32}"},
        {out: f"xor({out}_z, {out}_z >> 16)"},
    ]


@query(f"SELECT c_custkey, CAST(h AS BIGINT) AS hash FROM {lets('customer', murmur_levels('h', 'c_name', 'c_nationkey'))}")
def murmur_hashes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", hashing.murmur3_column(F.col("c_name"), F.col("c_nationkey").cast("long")).alias("hash"))


_INDEX = lets("part", [*murmur_levels("ns", "'maker'", "0"), *murmur_levels("h", "p_brand", "ns"), *murmur_levels("cons", "'Constant'", "0")])


@query(f"""WITH t AS (SELECT * FROM {_INDEX}) SELECT p_partkey, CAST(h & 262143::UBIGINT AS BIGINT) AS idx, 1.0::DOUBLE AS val FROM t
UNION ALL SELECT p_partkey, CAST((ns + p_size) & 262143::UBIGINT AS BIGINT), 0.5::DOUBLE FROM t""")
def feature_indices(spark, sf):
    """Names seeded by their namespace's hash; a number is itself, plus the seed."""
    f = F.array(features.feature("maker", F.col("p_brand")), features.feature("maker", F.col("p_size").cast("string"), 0.5))
    rows = online.hashed(table(spark, sf, "part").select("p_partkey", f.alias("features")), "features")
    return rows.select("p_partkey", F.explode(F.arrays_zip("idx", "val")).alias("z")).select("p_partkey", "z.idx", "z.val")


@query(f"SELECT p_partkey, CAST(h & 262143::UBIGINT AS BIGINT) AS idx FROM {lets('part', [*murmur_levels('ns', chr(39) + 'item' + chr(39), '0'), *murmur_levels('n', chr(39) + 'brand' + chr(39), 'ns'), *murmur_levels('h', 'p_brand', 'n')])}")
def chain_hash_indices(spark, sf):
    return table(spark, sf, "part").select("p_partkey", hashing.chained_index(F.lit("item"), F.lit("brand"), F.col("p_brand")).alias("idx"))


@query(f"""WITH {LOG_SQL}, s AS (SELECT event_id, (event_id::UHUGEINT * 17204839166893285485::UHUGEINT + 2147483647::UHUGEINT) % 18446744073709551616::UHUGEINT AS state FROM log),
u AS (SELECT event_id, CAST((state // 33554432::UHUGEINT) % 8388608::UHUGEINT AS DOUBLE) / 8388608 AS u FROM s)
SELECT event_id, round(u, 6) AS uniform, CAST(CASE WHEN u <= exp(-1) THEN 0 WHEN u <= 2 * exp(-1) THEN 1 WHEN u <= 2.5 * exp(-1) THEN 2 WHEN u <= (2.5 + 1 / 6.0) * exp(-1) THEN 3 WHEN u <= (2.5 + 1 / 6.0 + 1 / 24.0) * exp(-1) THEN 4 WHEN u <= (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0) * exp(-1) THEN 5 ELSE 6 END AS BIGINT) AS poisson FROM u""".replace("17204839166893285485", str(hashing.Merand48.A)))
def generator_draws(spark, sf):
    d = log(spark, sf).select("event_id", hashing.draws(F.col("event_id")).alias("d"))
    return d.select("event_id", r("d.uniform").alias("uniform"), F.least("d.poisson", F.lit(6)).alias("poisson"))


_TIME = "(p * 0.5::DOUBLE * 3)"
_TARGET = f"(y * x + exp(y * x) + {_TIME})"


@query(f"""WITH {LOG_SQL} SELECT event_id, round((y - x) * (1 - exp(-2 * {_TIME})) / 3, 6) AS squared,
  round(CASE WHEN 1 - y * x > 0 THEN y * least(p * 0.5::DOUBLE, (1 - y * x) / 3) ELSE 0 END, 6) AS hinge,
  round(y * (list_reduce(range(60), lambda v, i: v - (v + exp(v) - {_TARGET}) / (1 + exp(v)), CASE WHEN {_TARGET} > 1 THEN ln({_TARGET}) ELSE {_TARGET} END) - y * x) / 3, 6) AS logistic,
  round(CASE WHEN y > x THEN least(0.3::DOUBLE * p * 0.5, (y - x) / 3) WHEN y < x THEN -least(0.7::DOUBLE * p * 0.5, (x - y) / 3) ELSE 0 END, 6) AS quantile,
  round((ln((y + 2) / (1 + ((y + 2) / exp(x) - 1) * exp(-2 * {_TIME} * (y + 2)))) - x) / 3, 6) AS poisson FROM log""")
def invariant_steps(spark, sf):
    """Steps whose outcome is that of infinitely many small ones, by loss."""

    def run(batches):
        for d in batches:
            each = lambda name, shift=0.0, tau=0.5: [round(online.invariant_step(name, x, y + shift, p * 0.5, 3.0, tau), 6) + 0.0 for x, y, p in zip(d["x"], d["y"], d["p"], strict=True)]  # noqa: E731, B023
            yield pd.DataFrame({"event_id": d["event_id"], "squared": each("squared"), "hinge": each("hinge"), "logistic": each("logistic"), "quantile": each("quantile", 0.0, 0.3), "poisson": each("poisson", 2.0)})

    return log(spark, sf).select("event_id", "x", "y", "p").mapInPandas(run, "event_id long, squared double, hinge double, logistic double, quantile double, poisson double")


# --- writers --------------------------------------------------------------------------------------


@query(f"WITH {LOG_SQL} SELECT CAST(k / 2.0 AS DOUBLE) || ' u' || user_id AS value, count(*) AS n FROM log GROUP BY 1")
def prediction_lines(spark, sf):
    e = log(spark, sf).select((F.col("k") / 2.0).alias("p"), F.concat(F.lit("u"), F.col("user_id")).alias("tag"))
    return sinks.prediction_lines(e, "p", "tag").groupBy("value").agg(F.count("*").alias("n"))


@query(f"WITH {LOG_SQL} SELECT '1:' || CAST(k / 2.0 AS DOUBLE) || ' 2:' || CAST(k / 4.0 AS DOUBLE) AS value, count(*) AS n FROM log GROUP BY 1")
def raw_score_lines(spark, sf):
    e = log(spark, sf).select(F.array(F.col("k") / 2.0, F.col("k") / 4.0).alias("s"), "k")
    return sinks.prediction_lines(e, "k", raw="s").groupBy("value").agg(F.count("*").alias("n"))


@query(f"WITH {LOG_SQL} SELECT event_id, '0:' || ((k % 4) / 4.0)::DOUBLE || ',1:' || (1 - (k % 4) / 4.0)::DOUBLE || chr(10) AS value FROM log")
def action_probability_lines(spark, sf):
    q = (F.col("k") % 4) / 4.0
    e = log(spark, sf).select("event_id", F.array(q, 1 - q).alias("pmf"))
    return e.select("event_id", sinks.action_line("pmf").alias("value"))


def _brand_weights(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").agg((F.count("*") / 2.0).alias("w"))
    return p.select(F.array(features.feature("maker", F.col("p_brand"))).alias("features"), "p_brand", "w")


@query(f"""WITH b AS (SELECT p_brand, count(*) / 2.0 AS w FROM part GROUP BY p_brand), t AS (SELECT * FROM {lets('b', [*murmur_levels('ns', chr(39) + 'maker' + chr(39), '0'), *murmur_levels('h', 'p_brand', 'ns')])})
SELECT (h & 262143::UBIGINT) || ':' || CAST(w AS DOUBLE) AS readable, 'maker^' || p_brand || ':' || (h & 262143::UBIGINT) || ':' || CAST(w AS DOUBLE) AS named FROM t""")
def model_lines(spark, sf):
    """A model as ``index:weight`` lines, and with the names that the hash hides."""
    rows = online.hashed(_brand_weights(spark, sf), "features").select(F.lit("maker").alias("ns"), F.col("p_brand").alias("name"), F.get("idx", F.lit(0)).alias("idx"), "w")
    plain = sinks.readable_model(rows.select("idx", "w")).select(F.col("value").alias("readable"), F.split("value", ":")[0].alias("i"))
    named = sinks.named_model(rows.select("idx", "w"), rows.select("ns", "name", "idx")).select(F.col("idx").cast("string").alias("i"), F.col("value").alias("named"))
    return plain.join(named, "i").select("readable", "named")


@query("""SELECT '{"ns":"maker","name":"' || p_brand || '","w":' || CAST(count(*) / 2.0 AS DOUBLE) || '}' AS value FROM part GROUP BY p_brand""")
def model_json(spark, sf):
    return sinks.json_model(_brand_weights(spark, sf).select(F.lit("maker").alias("ns"), F.col("p_brand").alias("name"), "w"))


@query(f"WITH {LOG_SQL} SELECT event_id, y || ' ' || p || ' ''e' || event_id || ' |u k:' || CAST(k AS DOUBLE) || ' ' || event_type || ':1.0 |v val:' || CAST(k / 4.0 AS DOUBLE) AS value FROM log")
def example_text_lines(spark, sf):
    f = F.array(features.feature("u", F.lit("k"), F.col("k").cast("double")), features.feature("v", F.lit("val"), F.col("k") / 4.0), features.feature("u", F.col("event_type")))
    ex = log(spark, sf).select("event_id", "y", "p", F.concat(F.lit("e"), F.col("event_id")).alias("tag"), f.alias("features"))
    return ex.select("event_id", sinks.example_line("y", "p", "tag").alias("value"))


@query(f"""WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), t AS (SELECT * FROM {lets('b', [*murmur_levels('ns', chr(39) + 'maker' + chr(39), '0'), *murmur_levels('h', 'p_brand', 'ns')])})
SELECT 'maker' AS ns, p_brand AS name, CAST(h & 262143::UBIGINT AS BIGINT) AS idx, CASE WHEN n > 7 THEN n / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS w, n AS examples FROM t""")
def audited_model(spark, sf):
    """A hashed model's weights under the data's names; weights that the model lacks are 0."""
    ex = table(spark, sf, "part").select(F.array(features.feature("maker", F.col("p_brand"))).alias("features"))
    rows = online.hashed(_brand_weights(spark, sf).where("w > 3.5"), "features").select(F.get("idx", F.lit(0)).alias("idx"), "w")
    return sinks.audit_model(ex, rows)


@query(f"WITH {LOG_SQL} SELECT event_id, round(x, 6) AS p, 't' || event_id AS tag FROM log")
def typed_predictions(spark, sf):
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    rows = log(spark, sf).select("event_id", r("x").alias("p"), F.concat(F.lit("t"), F.col("event_id")).alias("tag"))
    return sinks.save_predictions(rows, f"{at.rstrip('/')}/predictions-{uuid.uuid4().hex}")


@query(f"WITH {COSTS_SQL} SELECT event_id, j, round(c, 6) AS c FROM costs WHERE c >= 0.5")
def exploded_action_costs(spark, sf):
    return log(spark, sf).select("event_id", F.posexplode(action_costs()).alias("j", "c")).select("event_id", F.col("j").cast("long").alias("j"), r("c").alias("c")).where("c >= 0.5")


# --- feature options ------------------------------------------------------------------------------

_EX = f"WITH {LOG_SQL}, f AS (SELECT event_id, 'alpha' AS ns, 'k' AS name, CAST(k AS DOUBLE) AS value FROM log UNION ALL SELECT event_id, 'alpha', event_type, 1.0 FROM log UNION ALL SELECT event_id, 'beta', 'val', value FROM log)"


def _three(spark, sf):
    f = F.array(features.feature("alpha", F.lit("k"), F.col("k").cast("double")), features.feature("alpha", F.col("event_type")), features.feature("beta", F.lit("val"), F.col("value")))
    return log(spark, sf).select("event_id", f.alias("features"))


def _products(where: str) -> str:
    return f"SELECT a.event_id, a.ns || '*' || b.ns, a.name || '*' || b.name, round(a.value * b.value, 6) FROM f a JOIN f b ON a.event_id = b.event_id WHERE {where}"


_SAME = "(a.ns < b.ns OR (a.ns = b.ns AND (a.name = 'k' OR b.name <> 'k')))"


@query(f"{_EX} SELECT event_id, ns, name, round(value, 6) AS value FROM f UNION ALL {_products(_SAME)}")
def wildcard_interactions(spark, sf):
    """Every pair of namespaces, each with itself too, sorted and unique."""
    return _features(Stack.parse("-q :: --noconstant").features(_three(spark, sf)), "event_id")


@query(f"{_EX} SELECT event_id, ns, name, round(value, 6) AS value FROM f WHERE ns = 'alpha' UNION ALL {_products(chr(39).join(['a.ns = ', 'alpha', ' AND b.ns = ', 'beta', '']))}")
def ignore_linear_interactions(spark, sf):
    """A namespace that is left out by itself and kept in interactions."""
    return _features(Stack.parse("-q ab --ignore_linear b --noconstant").features(_three(spark, sf)), "event_id")


@query(f"{_EX} SELECT event_id, ns, name, round(value, 6) AS value FROM f UNION ALL {_products(chr(39).join(['a.ns = ', 'alpha', ' AND b.ns = ', 'beta', '']))}")
def full_name_interactions(spark, sf):
    return _features(Stack.parse("--experimental_full_name_interactions alpha|beta --noconstant").features(_three(spark, sf)), "event_id")


@query(f"{_EX} SELECT event_id, ns, name, round(CASE WHEN ns = 'beta' THEN value * 0.5 ELSE value END, 6) AS value FROM f UNION ALL SELECT event_id, 'n', '0', CAST(k AS DOUBLE) FROM log UNION ALL SELECT event_id, 'n', '1', value FROM log")
def scaled_and_anonymous(spark, sf):
    """A namespace's values scaled; values without names named by their place."""
    ex = _three(spark, sf).join(log(spark, sf).select("event_id", F.col("k").cast("double").alias("k"), "value"), "event_id")
    f = F.concat(features.scale(F.col("features"), "beta", 0.5), features.anonymous("n", F.array("k", "value")))
    return _features(ex.select("event_id", f.alias("features")), "event_id")


# --- going on from a model, models after each pass ------------------------------------------------

_ADA = {"u": (D0, "u - 0.5::DOUBLE * sl * x / sqrt(greatest(gu2, 1e-300))"), "v": (D0, "v - 0.5::DOUBLE * sl / sqrt(greatest(gv2, 1e-300))"), "gu": (D0, "gu2"), "gv": (D0, "gv2")}
_ADA_LEVELS = [{"p": "least(greatest(u * x + v, -50), 50)"}, {"sl": "(-y / (1 + exp(y * p)))"}, {"gu2": "gu + sl * sl * greatest(x * x, 1.17549435e-38::DOUBLE)", "gv2": "gv + sl * sl"}]


def _resumed(spark, sf):
    """Half of each user's events are learnt, saved with their state, and a second run goes on from there."""
    run = online.Run(lambda: online.GD(loss="logistic", normalized=False, invariant=False, bits=1))
    rows = _stream(spark, sf)
    early = F.col("seq") % 1000 < 500
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{at.rstrip('/')}/model-{uuid.uuid4().hex}"
    sinks.save_model(online.train(rows.where(early), run, ["user_id"]).where("kind = 'weight'").select("user_id", "idx", "w", "state"), path)
    out = online.train(rows.where(~early), run, ["user_id"], start=sinks.load_model(spark, path)).where("kind = 'prediction'")
    return out.select(F.col("seq").alias("event_id"), (r("p") + 0.0).alias("p"))


register("resumed_training", _resumed, fold_sql("x, y", _ADA, _ADA_LEVELS, "event_id, round(p, 6) + 0.0 AS p", order="event_id % 1000 >= 500, event_id") + " WHERE event_id % 1000 >= 500")


def _per_pass(spark, sf):
    run = online.Run(lambda: online.GD(loss="logistic", rate=0.1, power=0.0, adaptive=False, normalized=False, invariant=False, bits=1), passes=3, save_per_pass=True)
    out = online.train(_stream(spark, sf), run, ["user_id"]).where("kind <> 'prediction'")
    return out.select("user_id", F.coalesce("seq", F.lit(3)).alias("passes"), "idx", r("w", 5).alias("w")).where("w <> 0")


_REPEATED = f"""WITH RECURSIVE {LOG_SQL}, o AS (SELECT user_id, event_id, x, y, rep, row_number() OVER (PARTITION BY user_id ORDER BY rep, event_id) AS n, row_number() OVER (PARTITION BY user_id, rep ORDER BY event_id) AS i
  FROM log, (SELECT unnest(range(4)) AS rep)),
s AS (SELECT o.*, {D0} AS u, {D0} AS v FROM o WHERE n = 1
 UNION ALL SELECT o.*, b.u, b.v FROM (SELECT user_id, n, u - 0.1::DOUBLE * sl * x AS u, v - 0.1::DOUBLE * sl AS v FROM (SELECT *, -y / (1 + exp(y * (u * x + v))) AS sl FROM s)) b JOIN o ON o.user_id = b.user_id AND o.n = b.n + 1)
SELECT user_id, rep AS passes, 0 AS idx, round(u, 5) AS w FROM s WHERE rep > 0 AND i = 1 AND round(u, 5) <> 0 UNION ALL SELECT user_id, rep, 1, round(v, 5) FROM s WHERE rep > 0 AND i = 1 AND round(v, 5) <> 0"""
register("weights_per_pass", _per_pass, _REPEATED)


# --- a model as the prior of the next; several models at once -------------------------------------


def _weighted(spark, sf):
    f = F.array(features.feature("a", F.col("event_type"), F.col("x")), features.feature("b", F.lit("one")))
    ex = log(spark, sf).select(F.col("event_id").alias("id"), "y", F.lit(1.0).alias("weight"), F.explode(f).alias("f")).select("id", "y", "weight", "f.ns", "f.name", "f.value")
    return ex, ex.select("ns", "name").distinct().withColumn("w", F.length("name") / 10.0 - 0.4)


_AT = """f AS (SELECT event_id, y, 'a' AS ns, event_type AS name, x AS value FROM log UNION ALL SELECT event_id, y, 'b', 'one', 1.0 FROM log),
w AS (SELECT DISTINCT ns, name, length(name) / 10.0::DOUBLE - 0.4 AS w FROM f), s AS (SELECT event_id, sum(value * w) AS p FROM f JOIN w USING (ns, name) GROUP BY event_id),
g AS (SELECT ns, name, sum(-y / (1 + exp(y * p)) * value) AS g, sum(abs(-y / (1 + exp(y * p))) * value * value) AS h FROM f JOIN s USING (event_id) GROUP BY ns, name)"""


@query(f"WITH {LOG_SQL}, {_AT} SELECT ns, name, round(g + 0.5 * w + CASE WHEN ns = 'a' THEN length(name) * (w - 0.1) ELSE 0 END, 4) AS g, round(h + 0.5 + CASE WHEN ns = 'a' THEN length(name) ELSE 0 END, 4) AS h FROM g JOIN w USING (ns, name)")
def prior_gradient(spark, sf):
    """A full gradient with the pull of l2 and of an earlier model's weights, each by its strength."""
    ex, w = _weighted(spark, sf)
    prior = w.where("ns = 'a'").select("ns", "name", F.lit(0.1).alias("w0"), F.length("name").cast("double").alias("strength"))
    out = batch.regularised(batch.gradient(ex, w), w, 0.5, prior)
    return out.select("ns", "name", r("g", 4).alias("g"), r("h", 4).alias("h"))


@query(f"WITH {LOG_SQL}, {_AT} SELECT ns, name, round(w, 6) AS w0, round(h + 0.25, 4) AS strength FROM g JOIN w USING (ns, name)")
def model_as_prior(spark, sf):
    ex, w = _weighted(spark, sf)
    return batch.prior_of(ex, w, l2=0.25).select("ns", "name", r("w0").alias("w0"), r("strength", 4).alias("strength"))


def _several(spark, sf):
    f = F.array(features.feature("u", F.concat(F.lit("k"), F.col("k") % 16)), features.feature("v", F.concat(F.lit("b"), F.floor(F.col("value") / 25) % 16)))
    label = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("event_type")).cast("double")
    rows = log(spark, sf).select("user_id", F.col("event_id").alias("seq"), F.lit(1.0).alias("weight"), f.alias("features"), label.alias("y"))
    stacks = {name: Stack.parse(f"--oaa 5 --sgd -l {rate} --power_t 0 --noconstant -b 14") for name, rate in (("fast", 0.1), ("slow", 0.05))}
    return fit_many(stacks, rows, ["user_id"]).select("model", "user_id", F.col("seq").alias("event_id"), r("p").alias("p"))


_OAA = ORACLE_SQL["oaa_plain_online"]
register("several_models", _several, f"SELECT 'fast' AS model, * FROM ({_OAA}) UNION ALL SELECT 'slow', * FROM ({_OAA.replace('0.1::DOUBLE * (', '0.05::DOUBLE * (')})")
