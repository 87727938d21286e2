"""The driver's tables seen as the engine's inputs: a decision log, regression rows, texts, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COST_SCALE = 487.0
#: Event types in the order of their action numbers.
ACTIONS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a decision log: logged action, its cost and probability, a context number k."""
    e = table(spark, sf_dir, "events")
    action = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("event_type")).cast("int") - 1
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "user_id", "event_type", "value", action.alias("a"), k.alias("k"), (F.col("value") / COST_SCALE).alias("cost"), ((1 + k % 8) / 10.0).alias("p"), ((k - 50) / 25.0).alias("x"), F.when(F.col("value") > 50, 1.0).otherwise(-1.0).alias("y"))


def action_costs(actions: int = 5) -> Column:
    """A cost in hundredths for each action of an event, from its context."""
    return F.array(*[((F.col("k") * (7 * (j + 3)) + F.col("event_id") * (13 * (j + 1))) % 101 / 100.0) for j in range(actions)])


LOG_SQL = """log AS (SELECT event_id, user_id, event_type, value, k, value / 487.0 AS cost, CAST((1 + k % 8) / 10.0 AS DOUBLE) AS p, CAST((k - 50) / 25.0 AS DOUBLE) AS x,
    CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS a
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
COSTS_SQL = LOG_SQL + """,
costs AS (SELECT event_id, j, CAST(((k * (7 * (j + 3)) + event_id * (13 * (j + 1))) % 101) / 100.0 AS DOUBLE) AS c FROM log, (SELECT unnest(range(5)) AS j))"""
