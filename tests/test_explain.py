import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.tables import doc_quality, part_price
from tabml.operators import attribution as A
from tabml.operators import importance as I
from tabml.operators.profile import metadata
from tabml.plans import explain as X
from tabml.plans import train as R

DOC = ("quality", ["letter_share", "n_chars", "lang", "source"], ["doc_id"], "binary_classification")
PART = ("p_retailprice", ["key_mod", "p_size", "p_type"], ["p_partkey"], "regression")


@pytest.fixture(scope="module")
def tree(spark, folder):
    ready = R.prepare(doc_quality(spark, folder), *DOC)
    return R.fit_model(ready, "DecisionTreeClassifier"), ready


def test_contributions_and_base_add_up_to_the_output(spark, folder, tree):
    trained, _ = tree
    docs = doc_quality(spark, folder)
    parts = X.shap_local(trained, docs, ["doc_id"], docs, samples=10, class_index=1)
    sums = parts.groupBy("doc_id").agg((F.sum("contribution") + F.max("base_value")).alias("total"))
    outputs = trained.output(docs, 1).select("doc_id", "output")
    assert sums.join(outputs, "doc_id").filter(F.abs(F.col("total") - F.col("output")) > 1e-9).isEmpty()
    assert sums.count() == docs.count()


def line(df):
    return df.withColumn("output", 3 * F.col("a") - 2 * F.col("b") + 0 * F.col("c"))


def test_sampled_values_of_a_line_are_exact_against_one_background_row(spark):
    df = spark.range(20).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(1.0).alias("c"))
    got = A.shapley_sampled(df, ["id"], ["a", "b", "c"], line, [(1.0, 1.0, 5.0)], samples=4).collect()
    for r in got:
        want = {"a": 3 * (r["id"] - 1), "b": -2 * (r["id"] % 3 - 1), "c": 0}[r["feature"]]
        assert abs(r["contribution"] - want) < 1e-9 and r["base_value"] == 1.0


def test_surrogate_orders_the_features_of_a_line(spark):
    df = spark.createDataFrame([(1, 10.0, 4.0, 1.0)], "id int, a double, b double, c double")
    rows = A.surrogate_local(df, ["id"], ["a", "b", "c"], line, [(0.0, 0.0, 0.0)], num_features=2).orderBy("place").collect()
    assert [r["feature"] for r in rows] == ["a", "b"]
    assert 25 < rows[0]["weight"] < 31 and -9 < rows[1]["weight"] < -6


def test_surrogate_weights_equal_weighted_ridge():
    masks, numbers, weights, base = A.surrogate_plan(3, 5, 60, 0)
    y = np.random.RandomState(3).normal(size=60)
    kernel = np.sqrt(np.exp(-(~masks).sum(axis=1) / (0.75 ** 2 * 3)))
    z = np.hstack([masks.astype(float), np.ones((60, 1))])
    full = np.linalg.solve(z.T @ (kernel[:, None] * z) + np.diag([1, 1, 1, 0]), z.T @ (kernel * y))
    assert np.allclose(weights.T @ y, full[:3]) and np.isclose(base @ y, full[3])


def test_shuffling_keeps_the_values(spark):
    df = spark.range(200).select("id", F.col("id").cast("double").alias("a"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("b"))
    rows = I.permuted(df, ["id"], ["a", "b"], shuffle_rows=60)
    assert rows.count() == 600
    for name in ("a", "b"):
        part = rows.filter(F.col("_feature") == name)
        assert part.select(name).exceptAll(df.select(name)).isEmpty()
    moved = rows.filter("_feature = 'a' AND a <> id").count()
    assert moved == 200 and rows.filter("_feature = 'a' AND NOT b <=> CASE WHEN id % 5 <> 0 THEN id END").isEmpty()


def test_the_key_feature_leads(spark, folder):
    ready = R.prepare(part_price(spark, folder), *PART)
    forest = R.fit_model(ready, "RandomForestRegressor", {"n_estimators": 20})
    top = I.importance(spark, forest.model, forest.prep.slots()).orderBy("rank").first()
    assert top["feature"] == "numeric__key_mod" and top["importance"] > 0.9
    permuted = I.importance_permutation(
        part_price(spark, folder).withColumn("label", F.col("p_retailprice")), ["p_partkey"], PART[1], forest.score, "regression")
    assert permuted.orderBy("rank").first()["feature"] == "key_mod"
    knn = R.fit_model(ready, "KNeighborsRegressor")
    assert I.importance(spark, knn.model, knn.prep.slots()).first()["method"] == "Not available"


def test_global_values(spark, folder, tree):
    trained, ready = tree
    docs = doc_quality(spark, folder)
    assert abs(X.shap_global(trained, docs, ["doc_id"], docs).agg(F.sum("importance")).first()[0] - 1) < 1e-9
    line_ready = R.prepare(part_price(spark, folder), *PART)
    fitted = R.fit_model(line_ready, "LinearRegression")
    parts = part_price(spark, folder)
    table = X.shap_global(fitted, parts, ["p_partkey"], parts)
    assert table.orderBy(F.desc("importance")).first()["feature"] == "numeric__key_mod"


def test_report(spark, folder, tree):
    trained, ready = tree
    docs = doc_quality(spark, folder)
    report = X.explain(docs, metadata(docs, "doc_id", target="quality"), trained, ready)
    sections = {r["section"] for r in report.collect()}
    assert sections == {"target_detection", "task_classification", "model_selection", "preprocessing", "model_performance", "feature_importance"}
    assert X.explain_model("XGBClassifier", metadata(docs, "doc_id", target="quality")).filter("item LIKE 'benefit%'").count() == 4
    assert X.explain_prep(docs, "quality").count() == 2                 # nothing is missing
