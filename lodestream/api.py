"""Estimators in the manner of pyspark.ml: options in, ``fit`` on a DataFrame, ``transform`` on another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import losses
from .plans.stack import Model, Stack
from .sources.examples import from_columns


@dataclass
class Regressor:
    """A linear model of columns; ``options`` are a stack's."""

    options: str = ""
    label: str = "label"
    namespaces: dict[str, list[str]] | None = None
    shards: int = 4
    order: str | None = None

    def fit(self, df: DataFrame) -> FittedRegressor:
        ex = from_columns(df, self.label, self.namespaces)
        key = F.col(self.order) if self.order else F.xxhash64(*df.columns)
        rows = ex.select(F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int").alias("shard"), key.cast("long").alias("seq"), "features", F.col("label_value").alias("y"), F.lit(1.0).alias("weight"))
        return FittedRegressor(self, Stack.parse(self.options).fit(rows, ["shard"]))


@dataclass
class FittedRegressor:
    estimator: Regressor
    model: Model

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        ex = from_columns(df, None, self.estimator.namespaces or {"": [c for c in df.columns if c not in (self.estimator.label, key)]})
        return df.join(self.model.transform(ex.select(key, "features"), key).withColumnRenamed("score", "prediction"), key, "left")


@dataclass
class Classifier(Regressor):
    """Two classes, labels -1 and 1; ``probability`` is the logistic of the score."""

    def fit(self, df: DataFrame) -> FittedClassifier:
        self.options = f"{self.options} --loss_function logistic".strip()
        return FittedClassifier(self, super().fit(df).model)


@dataclass
class FittedClassifier(FittedRegressor):
    def transform(self, df: DataFrame, key: str) -> DataFrame:
        out = super().transform(df, key)
        score = F.coalesce("prediction", F.lit(0.0))
        return out.withColumn("probability", losses.link("logistic", score)).withColumn("prediction", F.when(score > 0, 1).otherwise(-1))


@dataclass
class MulticlassClassifier(Regressor):
    """Classes of any type, learnt one against all; ``fit`` numbers them in sorted order."""

    def fit(self, df: DataFrame) -> FittedMulticlass:
        classes = [r[0] for r in df.select(self.label).where(F.col(self.label).isNotNull()).distinct().orderBy(self.label).collect()]
        fitted = []
        for k in classes:
            one = df.withColumn(self.label, F.when(F.col(self.label) == F.lit(k), 1.0).otherwise(-1.0))
            fitted.append(Classifier(self.options, self.label, self.namespaces, self.shards, self.order).fit(one))
        return FittedMulticlass(self, classes, fitted)


@dataclass
class FittedMulticlass:
    estimator: MulticlassClassifier
    classes: list
    models: list[FittedClassifier]

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """``prediction`` is the class with the highest score (the first of ties); ``scores`` are in the order of ``classes``."""
        out = df
        for k, model in enumerate(self.models):
            own = FittedRegressor.transform(model, df.select(*df.columns), key).select(key, F.coalesce("prediction", F.lit(0.0)).alias(f"__{k}"))
            out = out.join(own, key)
        scores = F.array(*[F.col(f"__{k}") for k in range(len(self.models))])
        best = F.get(F.array(*[F.lit(c) for c in self.classes]), F.array_position(scores, F.array_max(scores)).cast("int") - 1)
        return out.withColumn("scores", scores).withColumn("prediction", best).drop(*[f"__{k}" for k in range(len(self.models))])
