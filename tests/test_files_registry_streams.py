import datetime

import pytest
from pyspark.sql import functions as F

from checks import fixtures as W
from checks import lifecycle as Q
from tabml.operators import monitor as M
from tabml.operators import registry as G
from tabml.session import scratch_path, shared_folder
from tabml.sources import files as S
from tabml.sources import task_log as T
from tabml.streaming import jobs as J

TEXT = 'id,flag,num,whole,text,none\n1,True,1.5,3,"a, ""b""\nc",\n2,false,NA,,N/A,NaN\n3,TRUE,-2e3,7,x,null\n'


@pytest.fixture()
def home(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)
    return write


def check(df):
    assert df.dtypes == [("id", "bigint"), ("flag", "boolean"), ("num", "double"), ("whole", "bigint"), ("text", "string"), ("none", "double")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, True, 1.5, 3, 'a, "b"\nc', None), (2, False, None, None, None, None), (3, True, -2000.0, 7, "x", None)]


def test_csv_types_na_words_quotes_and_line_breaks(spark, home):
    check(S.load(spark, home("people.CSV", TEXT)))
    check(S.load(spark, home("people.data", TEXT)))                    # unknown suffix
    check(S.load(spark, home("people.tsv", TEXT.replace(",", "\t").replace("a\t ", "a, "))))


def test_whole_numbers_end_where_bigint_ends(spark):
    from pyspark.sql import Row
    cells = {"top": ["9223372036854775807", "-9223372036854775808", " +7 "], "beyond": ["9223372036854775808", "1", "2"], "dot": ["12.", "1", "2"],
             "exponent": ["1e5", "1", "2"], "far": ["1" * 400, "1", "2"], "mixed": ["1", "x", None], "gone": ["NA", "", None], "truth": ["true", "False", None]}
    df = S.typed(spark.createDataFrame([Row(**{c: v[i] for c, v in cells.items()}) for i in range(3)], ", ".join(f"{c} string" for c in cells)))
    assert dict(df.dtypes) == {"top": "bigint", "beyond": "double", "dot": "double", "exponent": "double", "far": "double", "mixed": "string",
                               "gone": "double", "truth": "boolean"}
    assert [r["top"] for r in df.collect()] == [2**63 - 1, -2**63, 7] and df.first()["beyond"] == 2.0**63


def test_types_of_decimals_cost_about_what_those_of_integers_cost(spark):
    from time import perf_counter
    def seconds(ending):
        words = spark.range(0, 1_200_000, 1, 8).select(*[F.concat(F.col("id") + i, F.lit(ending)).alias(f"c{i}") for i in range(4)])
        start = perf_counter()
        S.typed(words)
        return perf_counter() - start
    plain = min(seconds("") for _ in range(2))
    assert min(seconds(".5") for _ in range(2)) < 3 * plain + 0.5       # a failing cast per cell takes ten times as long


def test_json_array(spark, home):
    df = S.load(spark, home("people.json", '[\n {"a": 1, "b": "x"},\n {"a": null, "b": "y"}\n]'))
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "x"), (None, "y")]


def test_old_workbooks_are_refused(spark):
    with pytest.raises(ValueError):
        S.load(spark, "book.xls")


def test_workbooks_of_all_cell_kinds(spark, home):
    import pandas as pd
    rows = pd.DataFrame({"n": [1, 2], "x": [1.5, None], "s": ["a & b", "NA"], "b": [True, False], "d": [pd.Timestamp("2024-02-29 12:30:00")] * 2})
    folder = home("one.xlsx", W.workbook(rows)).rsplit("/", 1)[0]
    home("two.xlsx", W.workbook(rows[["x", "n", "d", "b", "s"]].assign(n=[3, 4])))     # other column order
    df = S.load(spark, folder + "/*.xlsx")
    assert df.dtypes == [("n", "bigint"), ("x", "double"), ("s", "string"), ("b", "boolean"), ("d", "timestamp_ntz")]
    got = df.orderBy("n").collect()
    assert [r["n"] for r in got] == [1, 2, 3, 4] and [r["s"] for r in got] == ["a & b", None] * 2
    assert got[0]["d"] == datetime.datetime(2024, 2, 29, 12, 30) and [r["x"] for r in got] == [1.5, None] * 2


def test_records_save_and_snapshot(spark):
    one = S.read_records(spark, {"a": 1, "b": "x"})
    assert one.count() == 1 and S.read_records(spark, [{"a": 1}, {"a": 2}]).count() == 2
    base = scratch_path(spark, "out")
    for suffix in (".csv", ".parquet"):
        S.save(one, base + suffix)
        assert [tuple(r) for r in S.load(spark, base + suffix).collect()] == [(1, "x")]
    assert S.load(spark, S.snapshot(one, base, "one") + "/*.parquet").count() == 1


def test_scratch_follows_the_named_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_folder(spark) + "/x-")


LOG = """{
 "t1": {"id": "t1", "type": "train_model", "status": "failed", "params": {"model_name": "RandomForest"},
  "created_at": "2031-02-03T04:05:06.000007", "started_at": "2031-02-03T04:05:07.000008", "completed_at": "2031-02-03T04:05:07.500008",
  "result": null, "error": "no column named y", "progress": 12},
 "t2": {"id": "t2", "type": "benchmark_models", "status": "completed", "params": {}, "created_at": "2031-05-01T10:00:00.250000",
  "started_at": "2031-05-01T10:00:01.250000", "completed_at": "2031-05-01T10:00:08.000001",
  "result": {"task_type": "regression", "best_model_name": "Ridge", "best_score": 0.75, "best_metric": "r2_score",
   "all_results": {"Ridge": {"r2_score": 0.75, "rmse": 1.4}, "SVR": {"error": "no rows"}}, "n_samples": 10, "n_features": 4},
  "error": null, "progress": 100}
}"""


def test_task_log(spark, home):
    log = T.read_task_log(spark, home("tasks.json", LOG))
    status = T.task_status(log, "t2").first()
    assert (status["status"], status["progress"], round(status["seconds"], 6)) == ("completed", 100, 6.750001)
    assert T.task_status(log, "t1").first()["error"] == "no column named y"
    rows = {tuple(r) for r in T.task_leaderboard(log).select("model", "metric", "value", "error").collect()}
    assert rows == {("Ridge", "r2_score", 0.75, None), ("Ridge", "rmse", 1.4, None), ("SVR", None, None, "no rows")}


def candidate(spark, rows):
    schema = """model_name string, version string, created_at timestamp_ntz, tags string, description string, task_type string,
 target_column string, training_accuracy double, evaluation_accuracy double, training_f1_score double, evaluation_f1_score double,
 training_r2_score double, evaluation_r2_score double, n_samples bigint, n_features bigint, model_type string"""
    full = [(n, v, datetime.datetime(2024, 1, d, 10, 0, s), t, None, "regression", "y", a, 0.5, None, None, None, 0.1, 9, 2, "Ridge")
            for n, v, d, s, t, a in rows]
    return spark.createDataFrame(full, schema)


def at(day):
    return F.lit(f"2024-03-{day:02d} 00:00:00").cast("timestamp_ntz")


def test_registry_life(spark):
    empty = spark.createDataFrame([], G.SCHEMA)
    path = scratch_path(spark, "registry")
    G.append(G.save_versions(empty, candidate(spark, [("m", None, 1, 5, "a, b ,c", 0.9), ("m", "v2", 2, 0, "", 0.0), ("m", "v2", 3, 0, "x", 0.7)])), path)
    events = spark.read.schema(G.SCHEMA).parquet(path)
    models = [r.asDict() for r in G.newest_first(G.list_models(events)).collect()]
    assert [(m["id"], m["version"], m["accuracy"], m["tags"], m["is_active"]) for m in models] == [
        (2, "v2", 0.5, [], True), (1, "v20240101_100005", 0.9, ["a", "b", "c"], True)]
    assert models[1]["file_path"] == "models/m_v20240101_100005" and models[1]["r2_score"] == 0.1
    again = G.save_versions(events, candidate(spark, [("m", "v2", 4, 0, "", 0.9), ("n", "v2", 4, 0, "", 0.9)]))
    assert [(r["id"], r["model_name"]) for r in again.collect()] == [(3, "n")]
    G.append(again, path)
    events = spark.read.schema(G.SCHEMA).parquet(path)
    one = spark.createDataFrame([(1,)], "id bigint")
    G.append(G.activate(events, one, at(1)), path)
    G.append(G.deploy(spark.read.schema(G.SCHEMA).parquet(path), one, at(2)), path)
    events = spark.read.schema(G.SCHEMA).parquet(path)
    state = {r["id"]: (r["is_active"], r["is_deployed"]) for r in G.list_models(events).collect()}
    assert state == {1: (True, True), 2: (False, False), 3: (False, False)}
    assert G.activate(events, spark.createDataFrame([(99,)], "id bigint"), at(3)).isEmpty()
    old = G.expired(events, F.lit("2024-02-02 12:00:00").cast("timestamp_ntz"))
    assert {r["id"] for r in old.collect()} == {1, 2}
    events = events.unionByName(G.delete(events, old, at(4)))
    assert [r["id"] for r in G.list_models(events).collect()] == [3] and G.model_details(events, 1).isEmpty()


def test_threshold(spark):
    rows = M.threshold(spark.createDataFrame([(0.5,), (0.7,)], "test_score double")).collect()
    assert [(r["status"], r["message"]) for r in rows] == [
        ("warning", "Model performance below threshold: 0.5"), ("healthy", "Model performance OK")]


@pytest.mark.parametrize("name", ["monitor_stream", "io_stream", "predict_stream", "monitor_drift"])
def test_streams_give_rows(spark, folder, name):
    assert Q.QUERIES[name](spark, folder).count() > 0


def test_stream_equals_batch_for_closed_windows(spark, folder):
    events = Q._rule(Q.table(spark, folder, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = J.closed_windows(M.windowed_quality(events, "ts"), events, "ts", "10 MINUTES")
    stream = Q._drained(spark, J.quality_stream(Q._rule(Q._event_stream(spark, folder)), "ts"))
    assert batch.exceptAll(stream).isEmpty() and stream.exceptAll(batch).isEmpty()
