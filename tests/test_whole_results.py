"""No rows, columns or values get lost on the way, and results don't depend on limits."""

import json

import pytest
from pyspark.sql import functions as F

from checks.fixtures import workbook
from tabml.functions import ranks
from tabml.operators import evaluate as E
from tabml.operators import importance as I
from tabml.operators import prep as P
from tabml.operators import registry as G
from tabml.operators import split as S
from tabml.plans import train as R
from tabml.plans import tune as U
from tabml.sources import files


def test_json_lines_arrays_and_single_values(spark, tmp_path):
    records = [{"a": i, "t": "x\ny" if i % 2 else None} for i in range(6)]
    texts = {
        "lines.json": "\n".join(map(json.dumps, records)), "blank.json": "\n\n" + "\n\n".join(map(json.dumps, records)) + "\n",
        "array.json": json.dumps(records), "pretty.json": json.dumps(records, indent=1), "row_per_line.json": "[" + ",\n".join(map(json.dumps, records)) + "]"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        assert files.load(spark, str(tmp_path / name)).count() == 6, name
    mixed = tmp_path / "mixed.json"
    mixed.mkdir()
    for i, text in enumerate(texts.values()):
        (mixed / f"{i}.json").write_text(text)
    (mixed / "more.json").write_text('{"b": 1}\n{"a": 7}')
    both = files.load(spark, str(mixed))
    assert both.count() == 32 and set(both.columns) == {"a", "b", "t"}


def test_csv_files_with_and_without_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,"x\ny"\n2,z\n')
    (tmp_path / "b.csv").write_text('k,t\n3,plain\n4,"quo""ted"\n')
    rows = sorted(tuple(r) for r in files.load(spark, str(tmp_path / "*.csv")).collect())
    assert rows == [(1, "x\ny"), (2, "z"), (3, "plain"), (4, 'quo"ted')]


def test_workbooks_with_other_columns_repeated_and_empty_names(spark, tmp_path):
    import pandas as pd
    a = pd.DataFrame([[1, "p", 2.5, 9]], columns=["k", "x", "x", ""])
    b = pd.DataFrame([[2, True]], columns=["k", "extra"])
    for name, frame in (("a", a), ("b", b)):
        cells = frame.astype(object)
        (tmp_path / f"{name}.xlsx").write_bytes(workbook(cells))
    df = files.load(spark, str(tmp_path / "*.xlsx"))
    assert df.columns == ["k", "x", "x.1", "Unnamed: 3", "extra"]
    rows = sorted((r.k, r.x, r["x.1"], r["Unnamed: 3"], r.extra) for r in df.collect())
    assert rows == [(1, "p", 2.5, 9, None), (2, None, None, None, True)]


def test_gaps_in_new_rows_and_columns_of_one_level(spark):
    train = spark.createDataFrame([(1.0, "a", "one"), (3.0, "b", "one"), (5.0, "b", "one")], "n double, c string, k string")
    fresh = spark.createDataFrame([(None, None, None), (float("nan"), "b", "one")], train.schema)
    prep = P.fit_prep(train, ["n", "c", "k"], scale=False)
    assert [n for n, _ in prep.slots()] == ["numeric__n", "categorical__c_b"]
    assert [r.features.toArray().tolist() for r in prep.transform(fresh).select("features").collect()] == [[3.0, 1.0], [3.0, 1.0]]
    only = P.fit_prep(train, ["n", "k"], scale=False, unseen="keep")
    assert only.transform(fresh).select("features").first().features.toArray().tolist() == [3.0]


def test_many_classes_take_the_joined_table(spark, monkeypatch):
    df = spark.range(30).select("id", F.concat(F.lit("c"), F.col("id") % 7).alias("y"))
    labels = P.class_list(df, "y")
    few = sorted(P.encode(df, "y", labels).collect())
    monkeypatch.setattr(P, "FEW_LABELS", 2)
    assert sorted(P.encode(df, "y", labels).collect()) == few


def test_stratified_split_moves_no_wide_rows(spark, monkeypatch):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("y"), F.repeat(F.lit("wide"), 10).alias("text"))
    monkeypatch.setattr(S, "FEW_CLASSES", 0)
    joined = sorted(S.split_stratified(df, ["id"], "y").collect())
    monkeypatch.undo()
    out = S.split_stratified(df, ["id"], "y")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(out.collect()) == joined


def test_auc_ignores_missing_scores(spark):
    rows = [(1, 0.9), (0, 0.1), (1, float("nan")), (0, None), (None, 0.5), (1, 0.05)]
    assert E.roc_auc(spark.createDataFrame(rows, "label int, score double")).first().roc_auc == 0.5


@pytest.mark.parametrize("rows", [7, 100, 100_000])
def test_shuffling_does_not_depend_on_ranges(spark, rows):
    df = spark.range(300).select("id", (F.col("id") * 2).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    whole = sorted(I.permuted(df, ["id"], ["a", "b"], shuffle_rows=300).collect(), key=repr)
    assert sorted(I.permuted(df, ["id"], ["a", "b"], shuffle_rows=rows).collect(), key=repr) == whole


def test_quantiles_do_not_depend_on_the_path(spark, monkeypatch):
    df = spark.range(5000).select((F.xxhash64("id") % 1000).cast("double").alias("x"))
    one = ranks.exact_quantiles(df, ["x"], [0.1, 0.5, 0.75])
    monkeypatch.setattr(ranks, "BRACKET_ROWS", 50)
    assert ranks.exact_quantiles(df, ["x"], [0.1, 0.5, 0.75], one_pass_rows=10) == one


def test_reports_hold_auc_matrix_and_classes(spark):
    df = spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 > 8).cast("int").alias("y"))
    ready = R.prepare(df, "y", ["x"], ["id"], "binary_classification")
    report = R.evaluation_report(R.fit_model(ready, "LogisticRegression"), ready).collect()
    fields = {(r.section, r.field) for r in report}
    assert {("evaluation", "roc_auc"), ("confusion_matrix", "0 as 1"), ("class_report", "1 recall"), ("verdict", "overall")} <= fields
    ready.release()


def test_clusters_need_no_target(spark):
    df = spark.range(90).select("id", (F.col("id") % 3 * 10.0).alias("x"))
    ready = R.prepare(df, None, ["x"], ["id"], "clustering")
    assert ready.rows.count() == 90 and "label" not in ready.rows.columns
    ready.release()


def test_versions_are_saved_loaded_and_active(spark, tmp_path):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    ready = R.prepare(df, "y", ["x"], ["id"], "regression")
    trained = R.fit_model(ready, "LinearRegression")
    where = str(tmp_path / "events"), str(tmp_path / "models")
    assert G.read_events(spark, where[0]).count() == 0
    first = G.save_version(trained, *where, "m", "v1", metrics={"r2_score": 0.9})
    second = G.save_version(trained, *where, "m", "v2")
    with pytest.raises(ValueError):
        G.save_version(trained, *where, "m", "v1")
    loaded = G.load_version(spark, where[0], first)
    assert abs(loaded.predict(df).where("id = 7").first().prediction - 14) < 1e-6
    state = {r.id: r.is_active for r in G.list_models(G.read_events(spark, where[0])).collect()}
    assert state == {first: True, second: False}
    with pytest.raises(ValueError):
        G.load_version(spark, where[0], 99)
    ready.release()


def test_tuning_names_its_grids(spark):
    assert len(U.settings("GradientBoostingClassifier")) == 4 and U.settings("GaussianNB") == [{}]
    with pytest.raises(ValueError):
        U.settings("NoSuchModel")
