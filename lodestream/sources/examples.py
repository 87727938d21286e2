"""Readers: text lines, JSON, decision logs and CSV as DataFrames of examples.

An example is (seq, label, weight, initial, tag, features array<struct<ns, name, value>>), or, for
multi-line formats, one row for each line with ``kind`` and its event's id.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES = "array<struct<ns:string,name:string,value:double>>"
LINE = f"kind string, label string, label_value double, weight double, initial double, tag string, features {FEATURES}, corrupt string"
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")
#: Words at the beginning of a line of a multi-line event.
KINDS = ("shared", "ccb shared", "ccb action", "ccb slot", "slates shared", "slates action", "slates slot")


def _number(text: str, strict: bool) -> float:
    if _FLOAT.match(text):
        return float(text)
    if strict:
        raise ValueError(f"malformed number {text!r}")
    return 0.0


def parse_line(line: str, strict: bool = False) -> dict:
    """One line ``label [weight [initial]] ['tag]|ns[:scale] name[:value] ...``.

    What stands before the first bar is the label; a word that touches the bar, or begins with an
    apostrophe, is the tag. Values of 0 are dropped; a feature without a name is named by its place."""
    head, *spaces = line.rstrip("\r\n").split("|")
    words, tag = head.split(), None
    if words and (words[-1].startswith("'") or (spaces and head and not head[-1].isspace() and (len(words) > 1 or not _FLOAT.match(words[-1])) and ":" not in words[-1])):
        tag = words.pop().lstrip("'")
    kind = next((k for k in sorted(KINDS, key=len, reverse=True) if " ".join(words).startswith(k)), "")
    rest = words[len(kind.split()) :]
    numbers = [w for w in rest if _FLOAT.match(w)] if rest and all(":" not in w for w in rest) else []
    out = {"kind": kind or ("action" if any(":" in w for w in rest) else ""), "label": " ".join(rest) or None, "tag": tag, "features": [], "corrupt": None}
    out["label_value"] = float(numbers[0]) if numbers else None
    out["weight"] = float(numbers[1]) if len(numbers) > 1 else 1.0
    out["initial"] = float(numbers[2]) if len(numbers) > 2 else 0.0
    for space in spaces:
        named = bool(space) and not space[0].isspace()
        parts = space.split()
        name, _, scale = (parts.pop(0) if named and parts else "").partition(":")
        by, blank = _number(scale, strict) if scale else 1.0, 0
        for word in parts:
            feature, colon, value = word.rpartition(":")
            if not colon:
                feature, x = word, 1.0
            else:
                x = _number(value, strict) if value or strict else 1.0
            if not feature:
                feature, blank = str(blank), blank + 1
            if x * by:
                out["features"].append({"ns": name, "name": feature, "value": x * by})
    return out


def read_text(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Example lines; a malformed number is 0 with the line in ``corrupt``, or an error if strict.

    Lines keep their file and order: (file, line number within a split) is not total over splits of a
    large file, so a stream that is learnt in order should carry its own sequence."""
    lines = spark.read.text(path)
    return parse_lines(lines, "value", strict)


def parse_lines(lines: DataFrame, column: str, strict: bool = False) -> DataFrame:
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema), LINE])

    def run(batches):
        feature = pa.list_(pa.struct([("ns", pa.string()), ("name", pa.string()), ("value", pa.float64())]))
        kinds = {"kind": pa.string(), "label": pa.string(), "label_value": pa.float64(), "weight": pa.float64(), "initial": pa.float64(), "tag": pa.string(), "features": feature, "corrupt": pa.string()}
        for batch in batches:
            rows = []
            for line in batch.column(batch.schema.names.index(column)).to_pylist():
                try:
                    rows.append(parse_line(line or "", True))
                except ValueError:
                    if strict:
                        raise
                    rows.append(parse_line(line or "") | {"corrupt": line})
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], [*batch.schema.names, *kinds])

    return lines.mapInArrow(run, fields)


def cost_labels(label: Column) -> Column:
    """``action:cost:probability`` words of a label as array<struct<action, cost, p>>; missing parts are null."""
    words = F.filter(F.split(F.coalesce(label, F.lit("")), "[ ,]+"), lambda w: w.contains(":"))
    part = lambda w, k: F.try_element_at(F.split(w, ":"), F.lit(k)).try_cast("double")
    return F.transform(words, lambda w: F.struct(part(w, 1).cast("int").alias("action"), part(w, 2).alias("cost"), part(w, 3).alias("p")))


def multilabels(label: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(label, F.lit("")), ","), lambda w: w.rlike("^[0-9]+$")), lambda w: w.cast("int"))


def with_events(lines: DataFrame, order: str, text: str, *by: str) -> DataFrame:
    """Multi-line examples: a blank line ends an event; ``event_id`` counts them within ``by``, such
    as the file, each of which is one task's sort."""
    if not by:
        raise ValueError("lines must be counted within something, such as their file")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blank = F.when(F.trim(text) == "", 1).otherwise(0)
    return lines.withColumn("event_id", F.coalesce(F.sum(blank).over(w), F.lit(0))).where(F.trim(text) != "")


def json_features(document: str | dict, ns: str = "") -> list[dict]:
    """Objects are namespaces, numbers values, strings ``name=value``, true a bare name, arrays of
    numbers values named by place; keys with an underscore are not features, but ``_text`` is words."""
    obj = json.loads(document) if isinstance(document, str) else document
    out: list[dict] = []

    def put(space, name, value):
        if value:
            out.append({"ns": space, "name": name, "value": float(value)})

    for key, x in (obj or {}).items():
        if key == "_text":
            for w in re.split("[ \t]+", str(x).translate(str.maketrans(":|", "__")).strip()):
                put(ns, w, bool(w))
        elif key.startswith("_"):
            continue
        elif isinstance(x, bool):
            put(ns, key, x)
        elif isinstance(x, (int, float)):
            put(ns, key, x)
        elif isinstance(x, str):
            put(ns, f"{key}={x}", 1)
        elif isinstance(x, dict):
            out += json_features(x, key)
        elif isinstance(x, list):
            for k, item in enumerate(x):
                if isinstance(item, dict):
                    out += json_features(item, key)
                elif isinstance(item, (int, float)) and not isinstance(item, bool):
                    put(key, str(k), item)
    return out


_JSON = f"label double, weight double, label_index int, action int, cost double, probability double, tag string, shared {FEATURES}, actions array<{FEATURES}>, slot_ids array<int>, slots array<struct<id:string,include:array<int>,features:{FEATURES}>>"


def json_example(document: str | dict) -> dict:
    """One JSON example: ``_label`` is a number or an object of Label, Weight; ``_label_cost``,
    ``_label_probability``, ``_label_Action`` and ``_labelIndex`` name a logged action; ``_multi`` has
    the actions (with ``_slot_id`` for slates), ``_slots`` the slots (``_id``, ``_inc``); the rest is shared."""
    obj = json.loads(document) if isinstance(document, str) else document
    label = obj.get("_label")
    parts = label if isinstance(label, dict) else {"Label": label}
    number = lambda x: None if x is None else float(x)
    actions = obj.get("_multi") or []
    return {
        "label": number(parts.get("Label")), "weight": float(parts.get("Weight", 1.0)), "label_index": obj.get("_labelIndex"), "action": obj.get("_label_Action"),
        "cost": number(obj.get("_label_cost")), "probability": number(obj.get("_label_probability")), "tag": obj.get("_tag"), "shared": json_features(obj),
        "actions": [json_features(a) for a in actions], "slot_ids": [a.get("_slot_id") for a in actions],
        "slots": [{"id": s.get("_id"), "include": s.get("_inc"), "features": json_features(s)} for s in obj.get("_slots") or []],
    }


def parse_json(lines: DataFrame, column: str) -> DataFrame:
    """``lines`` with the parts of the JSON example in ``column``; malformed JSON is an error."""
    import pyarrow.compute  # noqa: F401
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(_JSON)
    kinds = to_arrow_schema(made)

    def run(batches):
        for batch in batches:
            rows = [json_example(x) for x in batch.column(batch.schema.names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[f.name] for r in rows], f.type) for f in kinds)], [*batch.schema.names, *kinds.names])

    return lines.mapInArrow(run, StructType([*lines.schema.fields, *made.fields]))


_DECISION = "EventId string, Timestamp string, _label_cost double, _label_probability double, _label_Action int, _labelIndex int, _skipLearn boolean, pdrop double, a array<int>, p array<double>, c string, o string, _outcomes string"


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return parse_decisions(spark.read.text(path), "value")


def parse_decisions(lines: DataFrame, column: str) -> DataFrame:
    """Decision logs, one JSON object a line: cost, probability and index of the logged action,
    (action, probability) of all, the context as text, and the weight that dropped events leave to
    those that stayed. Events to be skipped are marked, never dropped here."""
    raw = lines.select(F.col(column).alias("value")).select(F.from_json("value", _DECISION).alias("d"), F.col("value").alias("_raw")).select("d.*", "_raw")
    weight = F.when(F.coalesce("pdrop", F.lit(0.0)) < 1, 1.0 / (1.0 - F.coalesce("pdrop", F.lit(0.0)))).otherwise(F.raise_error(F.lit("pdrop is 1: an event that is always dropped")).cast("double"))
    index = F.coalesce(F.col("_labelIndex"), F.col("_label_Action") - 1)
    return raw.select(
        F.col("EventId").alias("event_id"), F.col("Timestamp").alias("timestamp"), F.col("_label_cost").alias("cost"), F.col("_label_probability").alias("probability"), index.alias("chosen"),
        F.transform(F.arrays_zip(F.col("a").alias("a"), F.col("p").alias("p")), lambda z: F.struct(z["a"].alias("action"), z["p"].alias("p"))).alias("distribution"),
        weight.alias("weight"), F.coalesce("_skipLearn", F.lit(False)).alias("skip_learn"), F.coalesce("c", F.get_json_object("_raw", "$.c")).alias("context"), F.coalesce("o", "_outcomes").alias("outcomes"),
    )


def decision_actions(decisions: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(event columns, shared features, actions array<features>) of decision logs' contexts."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in decisions.schema), f"shared {FEATURES}, actions array<{FEATURES}>"])
    feature = pa.list_(pa.struct([("ns", pa.string()), ("name", pa.string()), ("value", pa.float64())]))

    def run(batches):
        for batch in batches:
            shared, actions = [], []
            for c in batch.column(batch.schema.names.index("context")).to_pylist():
                obj = json.loads(c) if c else {}
                keep = lambda fs: [f for f in fs if f"{f['ns']}|{f['name']}" not in ignore]
                shared.append(keep(json_features({k: v for k, v in obj.items() if k != "_multi"})))
                actions.append([keep(json_features(a)) for a in obj.get("_multi", [])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared, feature), pa.array(actions, pa.list_(feature))], [*batch.schema.names, "shared", "actions"])

    return decisions.mapInArrow(run, fields)


def read_csv(spark: SparkSession, path: str, separator: str = ",", header: list[str] | None = None, file_header: bool = True, scales: dict[str, float] | None = None) -> DataFrame:
    """CSV as examples: columns ``ns|feature`` or ``feature``; ``_label`` and ``_tag`` are what they say.

    Numbers are values, other text is ``feature=text``; quotes double inside quotes; a row with
    another number of cells than the header is an error; ``scales`` multiplies namespaces."""
    if separator in '"|:':
        raise ValueError(f"{separator!r} can't separate")
    reader = spark.read.option("sep", separator).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", "false")
    df = reader.csv(path, header=file_header)
    return csv_examples(df.toDF(*header) if header else df, scales)


def parse_csv(lines: DataFrame, column: str, header: list[str], separator: str = ",", scales: dict[str, float] | None = None) -> DataFrame:
    """The same for lines that a DataFrame holds; its other columns stay before the example's."""
    if separator in '"|:':
        raise ValueError(f"{separator!r} can't separate")
    names = [f"c{k}" for k in range(len(header))]
    cells = F.from_csv(F.col(column), ", ".join(f"{n} string" for n in names), {"sep": separator, "quote": '"', "escape": '"', "mode": "FAILFAST"})
    rest = [c for c in lines.columns if c != column]
    df = lines.select(*rest, cells.alias("__cells")).select(*rest, *[F.col(f"__cells.{n}").alias(h) for n, h in zip(names, header, strict=True)])
    return csv_examples(df, scales, rest)


def csv_examples(df: DataFrame, scales: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns of text as examples; those of ``keep`` are no features and stay."""
    parts = []
    for c in df.columns:
        if c in ("_label", "_tag", *(keep or ())):
            continue
        ns, _, name = c.rpartition("|")
        cell = F.col(f"`{c}`")
        number = cell.try_cast("double")
        scale = (scales or {}).get(ns, 1.0)
        parts.append(F.when(cell.isNotNull() & (cell != ""), F.struct(F.lit(ns).alias("ns"), F.when(number.isNotNull(), F.lit(name)).otherwise(F.concat(F.lit(f"{name}="), cell)).alias("name"), (F.coalesce(number, F.lit(1.0)) * scale).alias("value"))))
    features = F.filter(F.array(*parts), lambda f: f.isNotNull() & (f["value"] != 0))
    label = F.col("_label") if "_label" in df.columns else F.lit(None).cast("string")
    tag = F.col("_tag") if "_tag" in df.columns else F.lit(None).cast("string")
    return df.select(*(keep or ()), label.alias("label"), label.try_cast("double").alias("label_value"), F.lit(1.0).alias("weight"), tag.alias("tag"), features.cast(FEATURES).alias("features"))


def from_columns(df: DataFrame, label: str | None = None, namespaces: dict[str, list[str]] | None = None, tag: str | None = None, weight: str | None = None) -> DataFrame:
    """Any DataFrame's columns as examples: numbers are values, others ``column=value``."""
    namespaces = namespaces or {"": [c for c in df.columns if c not in (label, tag, weight)]}
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    one = lambda ns, c: F.struct(F.lit(ns).alias("ns"), (F.lit(c) if c in numeric else F.concat(F.lit(f"{c}="), F.col(c).cast("string"))).alias("name"), (F.col(c).cast("double") if c in numeric else F.lit(1.0)).alias("value"))
    features = F.filter(F.array(*[one(ns, c) for ns, cs in namespaces.items() for c in cs]), lambda f: f["name"].isNotNull() & (f["value"] != 0))
    pick = lambda c, default: F.col(c) if c else default
    return df.select(*df.columns, pick(label, F.lit(None).cast("double")).cast("double").alias("label_value"), pick(weight, F.lit(1.0)).alias("weight_"), pick(tag, F.lit(None).cast("string")).alias("tag_"), features.cast(FEATURES).alias("features"))


def first_examples(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` examples in order: Spark keeps ``n`` rows a task, never the whole sort."""
    return df.orderBy(order).limit(n)


def cached(examples: DataFrame, path: str) -> DataFrame:
    """Parsed examples as Parquet: later passes and runs read them without parsing."""
    examples.write.mode("overwrite").parquet(path)
    return examples.sparkSession.read.schema(examples.schema).parquet(path)
