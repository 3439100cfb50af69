import pytest
from pyspark.sql import functions as F

from tabml.operators import profile as P
from tabml.operators import target as T


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [(1.0, "a", None, True, 5), (float("nan"), "b", None, False, 5), (None, None, None, True, 5), (4.0, "a", None, None, 5)],
        "num double, cat string, empty double, flag boolean, constant int")


def test_nan_and_null_are_one_missing_value(odd):
    assert rows(P.null_counts(odd), "column", "missing") == {("num", 2), ("cat", 1), ("empty", 4), ("flag", 1), ("constant", 0)}
    assert rows(P.nunique(odd), "column", "distinct") == {("num", 2), ("cat", 2), ("empty", 0), ("flag", 2), ("constant", 1)}
    d = {r["column"]: r for r in P.describe(odd).collect()}
    assert (d["num"]["count"], d["num"]["mean"], d["num"]["p50"]) == (2, 2.5, 2.5)
    assert d["empty"]["count"] == 0 and d["empty"]["mean"] is None and d["empty"]["p50"] is None
    assert d["constant"]["std"] == 0
    flags = P.missing_flags(odd).first()
    assert flags["missing_numeric"] and flags["missing_categorical"]


def test_sketched_distinct_counts_only_hide_large_ones(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW_VALUES", 50)
    df = spark.range(2000).select("id", (F.col("id") % 7).alias("seven"))
    assert P.few_distinct(df) == {"id": None, "seven": 7}


def test_target_rules(spark):
    df = spark.range(40).select(
        F.col("id").alias("width"), (F.col("id") % 2).alias("flag"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("kind"),
        F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("other"), (F.col("id") % 5).alias("five"), F.col("id").cast("double").alias("many"))
    scores = dict((r["column"], r["score"]) for r in T.target_scores(df).collect())
    assert scores == {"flag": 8, "kind": 10, "other": 10, "five": 4, "many": 2}      # width holds 'id'
    best = T.detect_target(df).first()
    assert (best["target_column"], best["method"], best["confidence_score"]) == ("kind", "binary_classification_target", 10)
    last = T.detect_target(df.select("width", F.col("width").alias("row_no"))).first()
    assert (last["target_column"], last["method"], last["confidence_score"]) == ("row_no", "fallback_last_column", 1)


def test_task_rules(spark):
    df = spark.range(100).select("id", (F.col("id") % 20).alias("twenty"), (F.col("id") % 21).alias("more"), (F.col("id") % 2).alias("two"),
                                 F.repeat(F.lit("x"), 21).alias("text"))
    short = df.drop("text")
    assert T.classify_task(short, "twenty", "id").first()["task_type"] == "multiclass_classification"
    assert T.classify_task(short, "more", "id").first()["task_reason"] == "continuous_target_with_21_unique_values"
    assert T.classify_task(short, "two", "id").first()["task_type"] == "binary_classification"
    nlp = T.classify_task(df, "two", "id").first()
    assert (nlp["task_type"], nlp["task_reason"]) == ("nlp", "text_columns_detected: ['text']")
    assert T.classify_task_by_ratio(short, "two").first()["task_type"] == "binary_classification"
    assert T.classify_task_by_ratio(short, "twenty").first()["task_type"] == "regression"


def test_metadata_record(spark):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2], None if i == 3 else "z") for i in range(12)], "k bigint, v double, y string, c string")
    r = P.metadata(df, "k").first()
    assert (r["target_column"], r["task_type"], r["n_samples"], r["n_features"], r["n_classes"]) == ("y", "binary_classification", 12, 4, 2)
    assert r["feature_columns"] == ["k", "v", "c"] and r["numeric_features"] == ["k", "v"] and r["categorical_features"] == ["c"]
    assert r["missing_values"] == {"k": 0, "v": 0, "c": 1} and r["confidence_score"] == 10
    assert P.metadata(df, "k", target="v").first()["confidence_score"] == 2


def test_model_choice(spark):
    tasks = spark.createDataFrame([("binary_classification", 2), ("multiclass_classification", 3), ("multiclass_classification", 11),
                                   ("regression", 50), ("clustering", 0), ("nlp", 2)], "task_type string, n_classes bigint")
    assert [r["selected_model"] for r in T.select_model(tasks).collect()] == [
        "LogisticRegression", "KNeighborsClassifier", "RandomForestClassifier", "RandomForestRegressor", "KMeans", "RandomForestClassifier"]


def test_distinct_values_travel_one_by_one(spark):
    import datetime
    from contextlib import redirect_stdout
    from io import StringIO
    nan, day = float("nan"), datetime.date(2024, 1, 1)
    rows = [(1, 1, 0.0, 0.5, "a", True, day, None, [1]), (1, 2, -0.0, nan, "", None, day, None, [1]), (2, None, nan, None, None, False, None, None, [2])]
    df = spark.createDataFrame(rows, "a int, `b.c` bigint, d double, f float, s string, t boolean, day date, gone double, many array<int>")
    expected = [("a", 0, 2), ("b.c", 1, 2), ("d", 2, 1), ("f", 3, 1), ("s", 4, 2), ("t", 5, 2), ("day", 6, 1), ("gone", 7, 0), ("many", 8, 2)]
    assert sorted(map(tuple, P.nunique(df).collect()), key=lambda r: r[1]) == expected
    assert [r["distinct"] for r in P.nunique(df.limit(0)).collect()] == [0] * 9
    plan = StringIO()
    with redirect_stdout(plan):
        P.nunique(df).explain()
    assert "Expand" not in plan.getvalue()      # that step sends every value in a row as wide as the table
