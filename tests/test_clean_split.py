import math

import pytest
from pyspark.sql import functions as F

from tabml.operators import clean as C
from tabml.operators import split as S


def test_fill_ties_constants_and_empty_columns(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (None, "b", None), (10, "a", None), (3, None, None)],
                               "n int, s string, e double")
    filled = C.impute_mode(C.impute_median(df)).collect()
    assert [r["n"] for r in filled] == [1, 2, 2.5, 10, 3]
    assert [r["s"] for r in filled] == ["b", "a", "b", "a", "a"]      # tie: the smallest
    assert all(r["e"] is None for r in filled)


def test_outliers_go_column_after_column(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(10)] + [(1000.0, 5.0), (5.0, 1000.0), (None, 1.0)], "a double, b double")
    kept = C.iqr_filter(df)
    assert kept.count() == 10 and kept.agg(F.max("a"), F.max("b")).first()[:] == (9.0, 9.0)
    assert C.iqr_filter(df, exclude=("a",)).filter("a = 1000").count() == 1
    assert C.iqr_filter_joint(df).count() == 10


def test_columns_that_drop_no_row_share_their_passes(spark, monkeypatch):
    calls, found = [], C.exact_quantiles
    monkeypatch.setattr(C, "exact_quantiles", lambda df, columns, *a, **k: calls.append(columns) or found(df, columns, *a, **k))
    calm = spark.range(100).select(*[((F.col("id") * (i + 3)) % 101).alias(f"c{i}") for i in range(6)])
    assert C.iqr_filter(calm).count() == 100 and len(calls) == 1


@pytest.mark.parametrize("wild", [(), (0,), (3,), (1, 2), (0, 2, 5), (0, 1, 2, 3, 4, 5)])
def test_fences_are_those_of_one_column_after_the_other(spark, wild):
    far = lambda i: F.when(F.col("id") % 17 == i, F.lit(None) if i == 2 else F.col("id") * 40).otherwise((F.col("id") * (i + 3)) % 101)
    df = spark.range(200).select(*[(far(i) if i in wild else (F.col("id") * (i + 3)) % 101).alias(f"c{i}") for i in range(6)]).cache()
    rows = df.toPandas().astype("float64")
    for c in rows.columns:
        q1, q3 = rows[c].quantile(0.25), rows[c].quantile(0.75)
        rows = rows[rows[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    assert sorted(map(tuple, C.iqr_filter(df).toPandas().astype("float64").values.tolist())) == sorted(map(tuple, rows.values.tolist()))


def test_clean_counts(spark):
    df = spark.createDataFrame([(1.0, "a")] * 5 + [(2.0, None), (float("nan"), "b"), (3.0, "a")], "x double, y string")
    summary = C.clean_summary(df, C.clean(df)).first()
    assert summary[:] == (8, 4)
    assert C.clean(df, remove_duplicates=False, handle_missing=False, outlier_removal=False).count() == 8


@pytest.mark.parametrize("n", [1, 7, 100, 1003])
def test_random_split_is_exact_and_repeatable(spark, n):
    df = spark.range(n).repartition(3)
    one = S.split_random(df, ["id"])
    assert one.filter("split = 'test'").count() == math.ceil(0.2 * n)
    assert one.exceptAll(S.split_random(df.repartition(5), ["id"])).isEmpty()


def test_stratified_split_keeps_shares(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, "mid").otherwise(
        F.concat(F.lit("c"), F.col("id") % 7)).alias("y"))
    df = df.withColumn("y", F.when(F.col("id") != 5, F.col("y")))
    parts = S.split_stratified(df, ["id"], "y")
    assert parts.count() == 1000
    labelled = parts.filter("y IS NOT NULL")
    assert labelled.filter("split = 'test'").count() == math.ceil(0.2 * 999)
    for r in labelled.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert abs(r["t"] - 0.2 * r["n"]) <= 1


@pytest.mark.parametrize("n", [5, 23, 1000])
def test_folds_are_balanced(spark, n):
    sizes = sorted(r["count"] for r in S.kfold(spark.range(n), ["id"]).groupBy("fold").count().collect())
    assert sum(sizes) == n and len(sizes) == 5 and sizes[-1] - sizes[0] <= 1


def test_too_few_rows_for_folds(spark):
    with pytest.raises(ValueError):
        S.kfold(spark.range(3), ["id"])
