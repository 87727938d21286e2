"""Structured Streaming: progressive validation with state for each key, and model updates by micro-batch."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import online


def progressive_mean(stream: DataFrame, key: str, label: str, order: str, numerator: float = 0.5, denominator: float = 1.0) -> DataFrame:
    """(key, order, prediction, loss): each label is predicted by the mean of those before it for its
    key, then learnt. State for a key is two numbers; rows of a micro-batch are taken in order."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames, state: GroupState):
        num, den = state.get if state.exists else (numerator, denominator)
        frame, out = pd.concat(list(frames)).sort_values(order), []
        for y in frame[label]:
            out.append(num / den)
            num, den = num + y, den + 1
        state.update((num, den))
        yield pd.DataFrame({key: k[0], order: frame[order].to_numpy(), "prediction": out, "loss": [(p - y) ** 2 for p, y in zip(out, frame[label], strict=True)]})

    schema = f"`{key}` {kind}, `{order}` {stream.schema[order].dataType.simpleString()}, prediction double, loss double"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "num double, den double", "append", GroupStateTimeout.NoTimeout)


def windowed_value(stream: DataFrame, time: str, cost: str, ratio: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Off-policy value by event-time window: sums that combine before the shuffle, late rows up to a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), (F.sum(F.col(ratio) * F.col(cost)) / F.count("*")).alias("ips"))


def learn_in_batches(stream: DataFrame, make: Callable[[], online.Kernel], group: list[str], save: Callable[[DataFrame, int], None]):
    """A model for each micro-batch, given to ``save`` with the batch's number; a restart repeats a
    batch with the same number, so a ``save`` that overwrites by number is exact. Weights live in
    tables, not in the state store."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            save(online.train(batch, online.Run(make), group).where("kind = 'weight'"), number)

    return stream.writeStream.foreachBatch(each)


def learn_by_key(stream: DataFrame, key: str, order: str, make: Callable[[], online.Kernel]) -> DataFrame:
    """(key, order, prediction): a learner for each key whose state goes on from micro-batch to
    micro-batch; each example (idx, val, y, weight) is predicted, then learnt, in order within a
    micro-batch. A key's learner is kept in the state store, so give it few bits."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames, state: GroupState):
        model = pickle.loads(zlib.decompress(state.get[0])) if state.exists else make()
        frame = pd.concat(list(frames)).sort_values(order)
        out = []
        for idx, val, y, weight in zip(frame["idx"], frame["val"], frame["y"], frame["weight"], strict=True):
            i, v = np.asarray(idx, np.int64), np.asarray(val, np.float64)
            out.append(model.predict(i, v) if y is None or y != y else model.learn(i, v, y, weight))
        state.update((zlib.compress(pickle.dumps(model), 1),))
        yield pd.DataFrame({key: k[0], order: frame[order].to_numpy(), "prediction": np.array(out, np.float64)})

    schema = f"`{key}` {kind}, `{order}` {stream.schema[order].dataType.simpleString()}, prediction double"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "model binary", "append", GroupStateTimeout.NoTimeout)


def send(stream: DataFrame, deliver: Callable[[DataFrame, int], None]):
    """Examples handed on to another service, once for each micro-batch."""
    return stream.writeStream.foreachBatch(lambda batch, number: deliver(batch, number))
