"""Progressive validation and reporting statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_loss(df: DataFrame, loss: Column, weight: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(loss * weight) / F.sum(weight)).alias("average_loss"), F.sum(weight).alias("weight"))


def running_loss(df: DataFrame, loss: str, order: str, *by: str) -> DataFrame:
    """Average loss up to and with each row. Give ``by``: a stream without keys would be one partition."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_loss", F.avg(loss).over(w)).withColumn("seen", F.count("*").over(w))


def since_last(df: DataFrame, loss: str, order: str, by: list[str]) -> DataFrame:
    """Progress rows: number, total and loss of the rows between one power of two and the next, for each stream."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    dump = df.withColumn("dump", F.ceil(F.log2(n.cast("double"))).cast("int"))
    each = dump.groupBy(*by, "dump").agg(F.count("*").alias("n"), F.sum(loss).alias("total"))
    w = Window.partitionBy(*by).orderBy("dump").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select(*by, "dump", "n", (F.col("total") / F.col("n")).alias("since_last"), (F.sum("total").over(w) / F.sum("n").over(w)).alias("average_loss"))


def holdout(n: Column, period: int = 10, after: int = 0) -> Column:
    """Is the n-th row (from 1) held out: every ``period``-th, or all after a number."""
    return n > after if after else n % period == 0


def best_constant(df: DataFrame, label: str, loss: str = "squared", weight: Column | None = None, tau: float = 0.5, *by: str) -> DataFrame:
    """The constant with the least loss. logistic, hinge and quantile: for labels of two values."""
    w = F.lit(1.0) if weight is None else weight
    low, high = F.min(label), F.max(label)
    total = df.groupBy(*by).agg(F.sum(F.col(label) * w).alias("yw"), F.sum(w).alias("w"), low.alias("low"), high.alias("high"))
    share = (F.col("yw") - F.col("low") * F.col("w")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) / F.col("w")
    best = {
        "squared": F.col("yw") / F.col("w"),
        "logistic": F.log(share / (1 - share)),
        "hinge": F.when(share > 0.5, F.col("high")).otherwise(F.col("low")),
        "quantile": F.when(1 - share < tau, F.col("high")).otherwise(F.col("low")),
    }[loss]
    return total.select(*by, best.alias("best_constant"), F.col("w").alias("weight"))


def multiclass_log_loss(probabilities: Column, truth: Column, worst: float = 999.0) -> Column:
    p = F.get(probabilities, truth)
    return F.when(F.coalesce(p, F.lit(0.0)) > 0, -F.log(p)).otherwise(F.lit(worst))


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def confusion(df: DataFrame, predicted: str, truth: str, *by: str) -> DataFrame:
    return df.groupBy(*by, predicted, truth).agg(F.count("*").alias("n"))


def topic_coherence(docs: DataFrame, topics: DataFrame, doc: str, word: str) -> DataFrame:
    """Mean log (joint + 1) / single document frequency over pairs of a topic's words (topic, word, rank).

    Only the topics' words are joined; document counts are taken per word and pair."""
    few = docs.select(doc, word).distinct().join(topics.select(word).distinct(), word, "left_semi")
    single = few.groupBy(word).agg(F.count("*").alias("n"))
    pairs = topics.alias("a").join(topics.alias("b"), (F.col("a.topic") == F.col("b.topic")) & (F.col("a.rank") < F.col("b.rank"))).select(F.col("a.topic").alias("topic"), F.col(f"a.{word}").alias("x"), F.col(f"b.{word}").alias("y"))
    joint = pairs.select("x", "y").distinct().join(few.select(F.col(word).alias("x"), F.col(doc).alias("d")), "x").join(few.select(F.col(word).alias("y"), F.col(doc).alias("d")), ["y", "d"]).groupBy("x", "y").agg(F.count("*").alias("both"))
    scored = pairs.join(joint, ["x", "y"], "left").join(single.withColumnRenamed(word, "x"), "x", "left")
    return scored.groupBy("topic").agg(F.avg(F.log((F.coalesce("both", F.lit(0)) + 1) / F.coalesce("n", F.lit(1)))).alias("coherence"))


def extra_metrics(df: DataFrame, **metrics: Column) -> DataFrame:
    """Counters of a run as one row, with a JSON document of them."""
    one = df.agg(*[c.alias(k) for k, c in metrics.items()])
    return one.withColumn("json", F.to_json(F.struct(*metrics)))
