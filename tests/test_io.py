import pytest
from pyspark.sql import functions as F

from lodestream.api import Classifier, Regressor
from lodestream.operators import online
from lodestream.plans.stack import Stack
from lodestream.sources import examples as S
from lodestream.sources import sinks
from lodestream.streaming import progressive


def test_parse_line():
    x = S.parse_line("1 2.5 0.5 'tag|ns:2 a:3 b |other c:0 :4")
    assert (x["label_value"], x["weight"], x["initial"], x["tag"]) == (1.0, 2.5, 0.5, "tag")
    assert [(f["ns"], f["name"], f["value"]) for f in x["features"]] == [("ns", "a", 6.0), ("ns", "b", 2.0), ("other", "0", 4.0)]
    assert S.parse_line("| x")["label_value"] is None
    assert S.parse_line("shared | s")["kind"] == "shared" and S.parse_line("ccb slot 0:0.5:0.2 |")["kind"] == "ccb slot"
    assert S.parse_line("0:1.0:0.5 | a")["kind"] == "action"
    with pytest.raises(ValueError):
        S.parse_line("1 | a:x", strict=True)
    assert S.parse_line("1 | a:x")["features"] == []


def test_read_text_and_events(spark, tmp_path):
    (tmp_path / "a.txt").write_text("shared | u\n0:1.0:0.5 | a\n | b\n\nshared | v\n | c\n")
    lines = spark.read.text(str(tmp_path)).coalesce(1).withColumn("n", F.monotonically_increasing_id()).withColumn("file", F.lit("a"))
    events = S.with_events(lines, "n", "value", "file")
    assert [r["event_id"] for r in events.orderBy("n").collect()] == [0, 0, 0, 1, 1]
    parsed = S.parse_lines(events, "value").withColumn("costs", S.cost_labels(F.col("label")))
    got = parsed.orderBy("n").collect()
    assert [r["kind"] for r in got] == ["shared", "action", "", "shared", ""]
    assert got[1]["costs"][0].asDict() == {"action": 0, "cost": 1.0, "p": 0.5}
    assert S.read_text(spark, str(tmp_path)).count() == 6


def test_decisions(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"EventId":"e","_label_cost":-1,"_label_probability":0.8,"_label_Action":1,"_labelIndex":0,"pdrop":0.5,"a":[1,2],"p":[0.8,0.2],"c":{"user":{"age":3,"_text":"hi there"},"_multi":[{"x":{"f":"v"}},{"x":{"g":2}}]}}\n')
    r = S.decision_actions(S.read_decisions(spark, str(tmp_path))).first()
    assert (r["cost"], r["chosen"], r["weight"], r["skip_learn"]) == (-1.0, 0, 2.0, False)
    assert [f["name"] for f in r["shared"]] == ["age", "hi", "there"] and r["actions"][0][0]["name"] == "f=v" and r["actions"][1][0]["value"] == 2.0


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('_label,_tag,a|x,b|y,z\n1,t1,2,"say ""hi""",0\n-1,t2,,q,3\n')
    rows = S.read_csv(spark, str(tmp_path / "x.csv"), scales={"a": 10.0}).orderBy("tag").collect()
    assert [(f["ns"], f["name"], f["value"]) for f in rows[0]["features"]] == [("a", "x", 20.0), ("b", 'y=say "hi"', 1.0)]
    assert rows[1]["label_value"] == -1.0 and [f["name"] for f in rows[1]["features"]] == ["y=q", "z"]
    with pytest.raises(ValueError):
        S.read_csv(spark, str(tmp_path / "x.csv"), separator="|")


def test_sinks(spark, tmp_path):
    w = spark.createDataFrame([(2, 0.5, 1.0), (1, -1.0, 2.0), (3, 0.0, 0.0)], "idx long, w double, state double")
    assert [r["value"] for r in sinks.readable_model(w).collect()] == ["1:-1.0", "2:0.5"]
    names = spark.createDataFrame([("n", "a", 1)], "ns string, name string, idx long")
    assert [r["value"] for r in sinks.named_model(w, names).collect()][0] == "n^a:1:-1.0"
    sinks.save_model(w, str(tmp_path / "m"), keep_state=False)
    assert sinks.load_model(spark, str(tmp_path / "m")).columns == ["idx", "w"]
    lines = sinks.action_lines(spark.range(1).select(F.array(F.lit(0.25), F.lit(0.75)).alias("p")), "p")
    assert lines.first()["value"] == "0:0.25,1:0.75\n"
    ex = spark.createDataFrame([(1, [("n", "a", 2.0), ("n", "b", 1.0)])], "id long, features array<struct<ns:string,name:string,value:double>>")
    weights = spark.createDataFrame([("n", "a", 0.5)], "ns string, name string, w double")
    assert [(r["name"], r["product"]) for r in sinks.audit(ex, weights, "id").coalesce(1).collect()] == [("a", 1.0), ("b", 0.0)]
    assert sinks.initial_weights(names, "normal", seed=3).first()["w"] == sinks.initial_weights(names, "normal", seed=3).first()["w"]


def test_stack(spark):
    s = Stack.parse("--ccb_explore_adf --epsilon 0.1 -q ab --ftrl")
    assert [x for x, _ in s.layers] == ["ccb_explore_adf", "cb_explore_adf", "cb_adf", "csoaa_ldf"] and s.base == "ftrl"
    assert s.explain().splitlines()[-1].strip() == "ftrl"
    for bad in ("--no_such_option", "value", "-q"):
        with pytest.raises(ValueError):
            Stack.parse(bad)
    rows = [(k % 2, k, [("a", "x", float(k % 5)), ("b", "y", 1.0)], 1.0 if k % 5 > 2 else -1.0, 1.0) for k in range(200)]
    df = spark.createDataFrame(rows, "shard int, seq long, features array<struct<ns:string,name:string,value:double>>, y double, weight double")
    model = Stack.parse("--loss_function logistic -q ab -b 12 --passes 3 --holdout_off").fit(df, ["shard"])
    out = model.transform(df, "seq").join(df.select("seq", "y"), "seq").collect()
    assert sum((r["score"] > 0) == (r["y"] > 0) for r in out) >= 180
    assert model.merge(model).count() == model.weights.select("idx").distinct().count()


def test_estimators(spark):
    df = spark.createDataFrame([(k, float(k % 7), "red" if k % 2 else "blue", 1.0 if k % 7 > 3 else -1.0) for k in range(300)], "id long, x double, colour string, label double")
    fitted = Classifier(namespaces={"f": ["x", "colour"]}, order="id").fit(df)
    out = fitted.transform(df, "id").collect()
    assert sum(r["prediction"] == r["label"] for r in out) >= 250 and all(0 <= r["probability"] <= 1 for r in out)
    reg = Regressor(label="x", namespaces={"f": ["colour"]}, order="id").fit(df).transform(df, "id")
    assert reg.count() == 300 and "prediction" in reg.columns


def test_streaming(spark, tmp_path):
    rows = [(k % 3, k, float(k % 5)) for k in range(60)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "u long, n long, y double").repartition(1).write.parquet(src)
    stream = spark.readStream.schema("u long, n long, y double").parquet(src)
    q = progressive.progressive_mean(stream, "u", "y", "n").writeStream.outputMode("append").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    got = {r["n"]: r["prediction"] for r in spark.sql("SELECT * FROM progress").collect()}
    num, den = {u: 0.5 for u in range(3)}, {u: 1.0 for u in range(3)}
    for u, n, y in rows:
        assert got[n] == pytest.approx(num[u] / den[u])
        num[u], den[u] = num[u] + y, den[u] + 1
    saved = []
    ex = spark.readStream.schema("u long, n long, y double").parquet(src).select(F.col("u").alias("shard"), F.col("n").alias("seq"), F.array(F.lit(0).cast("long")).alias("idx"), F.array(F.lit(1.0)).alias("val"), "y", F.lit(1.0).alias("weight"))
    q = progressive.learn_in_batches(ex, lambda: online.GD(bits=1), ["shard"], lambda df, k: saved.append((k, df.count()))).start()
    q.processAllAvailable()
    q.stop()
    assert saved == [(0, 3)]
