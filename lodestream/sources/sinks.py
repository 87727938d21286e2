"""Writers: predictions, models in several forms, audits, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def prediction_lines(df: DataFrame, prediction: str, tag: str | None = None, raw: str | None = None) -> DataFrame:
    """``value [tag]`` lines; with ``raw``, an array of scores, ``class:score`` words instead."""
    value = F.concat_ws(" ", F.transform(raw, lambda s, i: F.concat((i + 1).cast("string"), F.lit(":"), s.cast("string")))) if raw else F.col(prediction).cast("string")
    return df.select(F.concat_ws(" ", value, F.col(tag)).alias("value") if tag else value.alias("value"))


def action_line(pmf: Column | str) -> Column:
    """``action:probability,...`` of a multi-action event, followed by an empty line."""
    words = F.transform(pmf, lambda p, i: F.concat(i.cast("string"), F.lit(":"), F.round(p, 6).cast("string")))
    return F.concat(F.concat_ws(",", words), F.lit("\n"))


def action_lines(df: DataFrame, pmf: str) -> DataFrame:
    return df.select(action_line(pmf).alias("value"))


def write_predictions(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def save_model(weights: DataFrame, path: str, keep_state: bool = True, **metadata: str) -> None:
    """A model is a table of weights; without its state it can predict but not go on learning."""
    cols = weights.columns if keep_state else [c for c in weights.columns if c not in ("state", "adapt", "norm")]
    out = weights.select(*cols)
    for k, v in metadata.items():
        out = out.withMetadata(cols[-1], {k: v})
    out.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def readable_model(weights: DataFrame, index: str = "idx", weight: str = "w", hexadecimal: bool = False) -> DataFrame:
    """``index:weight`` lines in order of the index: a range-partitioned sort, no single writer.
    Hexadecimal floats lose no digit."""
    number = F.format_string("%a", F.col(weight)) if hexadecimal else F.col(weight).cast("string")
    return weights.where(F.col(weight) != 0).orderBy(index).select(F.concat(F.col(index).cast("string"), F.lit(":"), number).alias("value"))


def example_line(label: str, weight: str | None = None, tag: str | None = None, features: str = "features") -> Column:
    """An example as text, ``label [weight] ['tag] |ns name:value ...``, a namespace a run of its features."""
    f = F.col(features)
    word = lambda x: F.concat(x["name"], F.lit(":"), x["value"].cast("string"))
    runs = F.transform(F.array_distinct(F.transform(f, lambda x: x["ns"])), lambda ns: F.concat(F.lit("|"), F.concat_ws(" ", ns, F.array_join(F.transform(F.filter(f, lambda x: x["ns"] == ns), word), " "))))
    head = F.concat_ws(" ", F.col(label).cast("string"), *([F.col(weight).cast("string")] if weight else []), *([F.concat(F.lit("'"), F.col(tag))] if tag else []))
    return F.concat_ws(" ", head, F.array_join(runs, " "))


def example_lines(examples: DataFrame, label: str, weight: str | None = None, tag: str | None = None, features: str = "features") -> DataFrame:
    return examples.select(example_line(label, weight, tag, features).alias("value"))


def named_model(weights: DataFrame, names: DataFrame, index: str = "idx", weight: str = "w") -> DataFrame:
    """``ns^name:index:weight``: the hash undone by joining the distinct names of the data (ns, name, idx)."""
    joined = weights.where(F.col(weight) != 0).join(names.dropDuplicates([index]), index, "left")
    return joined.select(index, F.concat_ws(":", F.concat_ws("^", "ns", "name"), F.col(index).cast("string"), F.col(weight).cast("string")).alias("value")).orderBy(index)


def json_model(weights: DataFrame) -> DataFrame:
    return weights.select(F.to_json(F.struct(*weights.columns)).alias("value"))


def audit(examples: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Every feature's share in a prediction: (key, ns, name, value, w, product), largest first within a key."""
    rows = examples.select(key, F.explode("features").alias("f")).select(key, "f.ns", "f.name", "f.value").join(weights, ["ns", "name"], "left")
    product = F.col("value") * F.coalesce("w", F.lit(0.0))
    return rows.select(key, "ns", "name", "value", F.coalesce("w", F.lit(0.0)).alias("w"), product.alias("product")).sortWithinPartitions(key, F.desc(F.abs("product")), "ns", "name")


def audit_model(examples: DataFrame, weights: DataFrame, bits: int = 18) -> DataFrame:
    """(ns, name, idx, w, examples): the weights under the names that the data has for them, and in how
    many examples each stands. Hash collisions show as several names with one index."""
    from ..operators.online import hashed

    names = examples.select(F.explode("features").alias("f")).groupBy("f.ns", "f.name").agg(F.count("*").alias("examples"))
    indexed = hashed(names.select("*", F.array(F.struct("ns", "name", F.lit(1.0).alias("value"))).alias("__f")), "__f", bits)
    found = indexed.select("ns", "name", F.get("idx", F.lit(0)).alias("idx"), "examples")
    return found.join(weights.select("idx", "w"), "idx", "left").select("ns", "name", "idx", F.coalesce("w", F.lit(0.0)).alias("w"), "examples")


def save_predictions(predictions: DataFrame, path: str) -> DataFrame:
    """Predictions as typed columns (Parquet) in place of text lines, and what reads them back."""
    predictions.write.mode("overwrite").parquet(path)
    return predictions.sparkSession.read.schema(predictions.schema).parquet(path)


def initial_weights(names: DataFrame, kind: str = "zero", value: float = 0.0, seed: int = 0, index: str = "idx") -> DataFrame:
    """Weights before learning: a constant, uniform, normal or truncated normal, by a hash of the index."""
    u = lambda salt: (F.pmod(F.xxhash64(F.col(index), F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal: Column = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    w = {"zero": F.lit(value), "random": u(0) - 0.5, "normal": normal, "truncated": F.greatest(F.least(normal, F.lit(2.0)), F.lit(-2.0))}[kind]
    return names.withColumn("w", w)
