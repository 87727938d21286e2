"""Feature operators on the example model: a row has ``features``, array<struct<ns, name, value>>.

Everything is an array expression inside the row, so a plan of feature operators has no shuffle;
the exceptions (dictionary lookup, marginals) say so.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.exploration import let

FEATURE = "struct<ns:string,name:string,value:double>"
CONSTANT_NAME = "Constant"


def feature(ns: Column | str, name: Column, value: Column | float = 1.0) -> Column:
    one = lambda x: F.lit(x) if isinstance(x, (str, float, int)) else x
    return F.struct(one(ns).alias("ns"), name.alias("name"), one(value).cast("double").alias("value"))


def bag_of(ns: str, words: Column, value: float = 1.0) -> Column:
    return F.transform(words, lambda w: feature(ns, w, value))


def namespace(features: Column, ns: str) -> Column:
    return F.filter(features, lambda f: f["ns"].startswith(ns) if len(ns) == 1 else f["ns"] == ns)


def ignore(features: Column, *spaces: str) -> Column:
    """Without the namespaces that begin with one of the characters."""
    return F.filter(features, lambda f: ~F.left(f["ns"], F.lit(1)).isin(*spaces))


def keep(features: Column, *spaces: str) -> Column:
    return F.filter(features, lambda f: F.left(f["ns"], F.lit(1)).isin(*spaces))


def ignore_feature(features: Column, ns: str, name: str) -> Column:
    return F.filter(features, lambda f: ~((f["ns"] == ns) & (f["name"] == name)))


def redefine(features: Column, rules: list[tuple[str, str]]) -> Column:
    """Rename namespaces; rules (to, from-characters) apply in order and the last that fits wins, ``:`` fits all."""

    def of(f: Column) -> Column:
        ns = f["ns"]
        for to, sources in rules:
            ns = F.lit(to) if ":" in sources else F.when(F.left(f["ns"], F.lit(1)).isin(*sources), F.lit(to)).otherwise(ns)
        return feature(ns, f["name"], f["value"])

    return F.transform(features, of)


def scale(features: Column, ns: str, by: float) -> Column:
    return F.transform(features, lambda f: feature(f["ns"], f["name"], F.when(f["ns"] == ns, f["value"] * by).otherwise(f["value"])))


def drop_zeros(features: Column) -> Column:
    return F.filter(features, lambda f: f["value"] != 0)


def constant(features: Column) -> Column:
    return F.array_append(features, feature("", F.lit(CONSTANT_NAME)))


def anonymous(ns: str, values: Column) -> Column:
    """Values without names are named by their place."""
    return F.transform(values, lambda v, i: feature(ns, i.cast("string"), v))


def sort_unique(features: Column) -> Column:
    """By namespace and name; of equal ones the first by value stays."""
    ordered = F.array_sort(F.transform(features, lambda f: F.struct(f["ns"], f["name"], f["value"])))

    def first(own: Column) -> Column:
        before = F.concat(F.array(F.lit(None)), F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))))
        marked = F.zip_with(own, before, lambda f, b: F.when(b.isNull() | (b["ns"] != f["ns"]) | (b["name"] != f["name"]), feature(f["ns"], f["name"], f["value"])))
        return F.filter(F.slice(marked, F.lit(1), F.greatest(F.size(own), F.lit(0))), lambda f: f.isNotNull())

    return let(ordered, first)


def limit(features: Column, n: int, ns: str | None = None) -> Column:
    """The first ``n`` of a namespace (of each alike with None given one at a time), sorted and unique."""
    if ns is None:
        return F.slice(sort_unique(features), 1, n)
    return F.concat(F.filter(features, lambda f: f["ns"] != ns), F.slice(sort_unique(F.filter(features, lambda f: f["ns"] == ns)), 1, n))


def _joined(a: Column, b: Column) -> Column:
    return feature(F.concat(a["ns"], F.lit("*"), b["ns"]), F.concat(a["name"], F.lit("*"), b["name"]), a["value"] * b["value"])


def quadratic(a: Column, b: Column, same: bool = False, permutations: bool = False) -> Column:
    """All pairs; of a namespace with itself only those in order, each with itself included, unless permutations are asked for."""
    if same and not permutations:
        return let(a, lambda own: F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 1, F.size(own)), lambda y: _joined(x, y)))))
    return let(b, lambda right: F.flatten(F.transform(a, lambda x: F.transform(right, lambda y: _joined(x, y)))))


def interactions(features: Column, spaces: list[str], permutations: bool = False) -> Column:
    """Products over one feature of each namespace; a namespace named twice in a row gives combinations with repetition."""
    groups: list[list] = []
    for s in spaces:
        if groups and groups[-1][0] == s and not permutations:
            groups[-1][1] += 1
        else:
            groups.append([s, 1])
    out = None
    for ns, times in groups:
        own = namespace(features, ns)
        part = own if times == 1 else quadratic(own, own, same=True) if times == 2 else _powers(own, times)
        out = part if out is None else quadratic(out, part)
    return out


def _powers(own: Column, times: int) -> Column:
    """Combinations with repetition of ``times`` features of one namespace, by their last index."""

    def of(held: Column) -> Column:
        rows = F.transform(held, lambda f, i: F.struct(i.alias("i"), f.alias("f")))
        for _ in range(times - 1):
            rows = F.flatten(F.transform(rows, lambda r: F.transform(F.slice(held, r["i"] + 1, F.size(held)), lambda y, j: F.struct((r["i"] + j).alias("i"), _joined(r["f"], y).alias("f")))))
        return F.transform(rows, lambda r: r["f"])

    return let(own, of)


def expand_wildcards(patterns: list[str], spaces: list[str], leave_duplicates: bool = False) -> list[tuple[str, ...]]:
    """Plan-time rewrite: ``:`` stands for any observed namespace; sorted and unique unless told otherwise."""
    out: list[tuple[str, ...]] = []
    for pattern in patterns:
        fixed = [c for c in pattern if c != ":"]
        for wild in combinations_with_replacement(sorted(spaces), len(pattern) - len(fixed)):
            out.append(tuple([*fixed, *wild]) if leave_duplicates else tuple(sorted([*fixed, *wild])))
    return out if leave_duplicates else sorted(set(out))


def interaction_sum_of_squares(features: Column, a: str, b: str) -> Column:
    """Sum of squared products without making the pairs: product of sums, or (s1^2 + s2) / 2 of one namespace."""
    square = lambda ns, k: F.aggregate(namespace(features, ns), F.lit(0.0), lambda t, f: t + F.pow(f["value"], F.lit(k)))
    return (square(a, 2) * square(a, 2) + square(a, 4)) / 2 if a == b else square(a, 2) * square(b, 2)


def merge_on_name(features: Column, a: str, b: str) -> Column:
    """Features that both namespaces have by name, values multiplied."""
    right = F.map_from_entries(F.transform(namespace(features, b), lambda f: F.struct(f["name"], f["value"])))

    def of(held: Column) -> Column:
        both = F.filter(namespace(features, a), lambda f: F.map_contains_key(held, f["name"]))
        return F.transform(both, lambda f: feature(F.lit(f"{a}{b}"), f["name"], f["value"] * F.element_at(held, f["name"])))

    return let(right, of)


def dictionary(examples: DataFrame, table: DataFrame, ns: str, id_cols: list[str], most_rows: int = 1_000_000) -> DataFrame:
    """Adds the features that a dictionary (token, name, value) has for the tokens of a namespace.

    The dictionary is broadcast if counted below ``most_rows``, else joined by shuffle."""
    words = examples.select(*id_cols, F.explode(namespace(F.col("features"), ns)).alias("f")).select(*id_cols, F.col("f.name").alias("token"))
    side = F.broadcast(table) if table.count() <= most_rows else table
    found = words.join(side, "token").groupBy(*id_cols).agg(F.array_sort(F.collect_list(feature(f"{ns}_dict", F.col("name"), F.col("value")))).alias("found"))
    out = examples.join(found, id_cols, "left")
    return out.withColumn("features", F.concat("features", F.coalesce("found", F.expr(f"CAST(array() AS array<{FEATURE}>)")))).drop("found")


def merge_shared(actions: Column, shared: Column) -> Column:
    """The shared features of an event added to each of its actions (array of arrays), inside the row."""
    return F.transform(actions, lambda a: F.concat(a, shared))


def neighbours(df: DataFrame, partition: list[str], order: str, column: str, offsets: list[int]) -> DataFrame:
    """Columns of the rows before (negative) and after within a sequence."""
    w = Window.partitionBy(*partition).orderBy(order)
    return df.select("*", *[(F.lag(column, -k) if k < 0 else F.lead(column, k)).over(w).alias(f"{column}_{'m' if k < 0 else 'p'}{abs(k)}") for k in offsets])


def marginal(df: DataFrame, by: list[str], order: list[str], label: str, numerator: float = 0.5, denominator: float = 1.0, weight: str | None = None) -> DataFrame:
    """``marginal``: the mean label of the earlier rows with the same id, from a prior.

    One shuffle by id; a window's running sums hold no group in memory beyond Spark's spillable buffer."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    y = F.col(label) * F.col(weight) if weight else F.col(label)
    n = F.col(weight) if weight else F.lit(1.0)
    return df.withColumn("marginal", (numerator + F.coalesce(F.sum(y).over(w), F.lit(0.0))) / (denominator + F.coalesce(F.sum(n).over(w), F.lit(0.0))))


def marginal_split(df: DataFrame, by: list[str], order: str, label: str, width: int, numerator: float = 0.5, denominator: float = 1.0) -> DataFrame:
    """The same with the running sums of an id split over stretches of ``width`` values of a whole-number
    ``order``: sums of stretches first, then those within one, so that no id is one task's work."""
    cut = df.withColumn("__stretch", F.floor(F.col(order) / width))
    sums = cut.groupBy(*by, "__stretch").agg(F.sum(label).alias("__s"), F.count(label).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__stretch", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"))
    inside = Window.partitionBy(*by, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own_s, own_n = F.coalesce(F.sum(label).over(inside), F.lit(0.0)), F.coalesce(F.count(label).over(inside), F.lit(0))
    out = cut.withColumn("__own_s", own_s).withColumn("__own_n", own_n).join(sums, [*by, "__stretch"])
    return out.withColumn("marginal", (numerator + F.col("__s") + F.col("__own_s")) / (denominator + F.col("__n") + F.col("__own_n"))).select(*df.columns, "marginal")


def marginal_decayed(df: DataFrame, by: list[str], order: list[str], label: str, decay: float, numerator: float = 0.5, denominator: float = 1.0) -> DataFrame:
    """``marginal`` from the earlier rows of the id, older ones fading by (1 - decay): one shuffle by id,
    then a stream over sorted rows that holds two numbers, however many rows an id has."""
    keep = 1 - decay
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(*by).alias("key"), F.struct(*by).alias("by"), F.col(label).cast("double").alias("y"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    rows = own.repartition("key").sortWithinPartitions("key", "by", *[f"o{k}" for k in range(len(order))]).select("row", "by", "y")

    def run(batches):
        last, num, den = None, numerator, denominator
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, (key, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key != last:
                    last, num, den = key, numerator, denominator
                out[i] = num / den
                if y is not None:
                    num, den = num * keep + y, den * keep + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["row", "marginal"])

    made = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("marginal", DoubleType())]))
    return made.select("row.*", "marginal")


def autolink(features: Column, prediction: Column, degree: int) -> Column:
    """Powers 1 to ``degree`` of a base prediction as features."""
    return F.concat(features, F.array(*[feature("autolink", F.lit(str(k)), F.pow(prediction, F.lit(k))) for k in range(1, degree + 1)]))


def exploded(examples: DataFrame, *cols: str) -> DataFrame:
    return examples.select(*cols, F.explode("features").alias("f")).select(*cols, "f.ns", "f.name", "f.value")
