import pytest
from pyspark.sql import functions as F

from caseloom.operators import records
from caseloom.sources import cases


def test_lookups_pairs_and_defaults(spark):
    wanted = spark.createDataFrame([("t", ["b", "x", "a"])], "task string, paths array<string>")
    manifest = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "task string, path string, size int")
    got = records.in_asked_order(wanted, "paths", manifest, ["task"]).orderBy("place").collect()
    assert [r["path"] for r in got] == ["b", "a"]
    df = spark.createDataFrame([([1, 2, 3], ["x", "y"], [])], "a array<int>, b array<string>, c array<int>")
    row = df.select(records.zipped(F.col("a"), F.col("b")).alias("z"), records.first_value(F.col("c"), F.col("a")).alias("d")).first()
    assert [tuple(p) for p in row["z"]] == [(1, "x"), (2, "y")] and row["d"] == [1, 2, 3]


def test_slim_and_fallback(spark):
    df = spark.createDataFrame([([("R1", "long text"), ("R2", "other")], ["R1"])], "m array<struct<id:string,body:string>>, f array<string>")
    got = df.select(records.slim(F.col("m"), ["id"], F.col("f"), ["body"], "id", 4).alias("s")).first()["s"]
    assert [tuple(x) for x in got] == [("R1", "long"), ("R2", None)]
    files = spark.createDataFrame([([("submission/b.json",), ("submission/a.json",), ("a.json",)], "Empty Report")], "f array<struct<path:string>>, r string")
    assert files.select(records.fallback_file(F.col("f"), F.col("r"), ["report"])).first()[0] == "submission/a.json"
    assert files.select(records.fallback_file(F.col("f"), F.col("r"), ["key"])).first()[0] is None


def test_detection_metrics(spark):
    data = [("x", True, True, 0.9, 3), ("x", True, True, 0.9, 1), ("x", False, True, 0.2, None), ("x", True, False, 0.7, None), ("x", True, False, 0.5, None)]
    df = spark.createDataFrame(data, "g string, detected boolean, is_real boolean, confidence double, tier int")
    assert tuple(records.detection_metrics(df, ["g"]).first())[1:] == (0.6667, 0.5, 0.665)


def test_case_documents(spark, tmp_path):
    for case, body in {"one": '{"a": 1}', "two": "broken"}.items():
        (tmp_path / case).mkdir()
        (tmp_path / case / "task_spec.json").write_text(body)
    (tmp_path / "one" / "quality_report.json").write_text('{"score": 0.5}')
    got = cases.load_documents(spark, str(tmp_path), ["task_spec", "quality_report"])
    rows = got.select(F.substring_index("case", "/", -1).alias("c"), F.try_variant_get("task_spec", "$.a", "int").alias("a"), F.try_variant_get("quality_report", "$.score", "double").alias("s")).orderBy("c").collect()
    assert [tuple(r) for r in rows] == [("one", 1, 0.5), ("two", None, None)]


def test_calibration_texts(spark):
    texts = spark.range(20).select(F.repeat(F.col("id").cast("string"), 101).alias("t"))
    first = [r["t"] for r in cases.calibration_texts(texts, "t", 5, 42).collect()]
    assert len(first) == 5 and first == [r["t"] for r in cases.calibration_texts(texts.repartition(3), "t", 5, 42).collect()]
    with pytest.raises(Exception, match="fewer than 50"):
        cases.calibration_texts(texts, "t", 50, 42).collect()


def test_carried_and_restored(spark):
    lines = spark.createDataFrame([("f", 1, 10), ("f", 2, None), ("f", 3, 20), ("f", 4, None)], "f string, n int, line int")
    assert [r["at"] for r in cases.carried(lines, ["f"], "n", F.col("line"), "at").orderBy("n").collect()] == [10, 10, 20, 20]
    now = spark.createDataFrame([("a", 9), ("report_r2", 2), ("b", 1)], "path string, v int")
    before = spark.createDataFrame([("a", 1), ("report_r1", 1)], "path string, v int")
    got = {tuple(r) for r in cases.restored(now, before, ["path"], F.col("path").rlike(r"_r\d+$")).collect()}
    assert got == {("a", 1), ("report_r1", 1), ("report_r2", 2)}
