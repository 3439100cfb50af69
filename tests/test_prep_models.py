import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.tables import doc_quality, part_price
from tabml.operators import models as M
from tabml.operators import prep as P
from tabml.operators.ward import ward_merge
from tabml.plans import leaderboard as L
from tabml.plans import train as R
from tabml.plans import tune as U
from tabml.session import scratch_path

DOC = ("quality", ["letter_share", "n_chars", "lang", "source"], ["doc_id"], "binary_classification")
PART = ("p_retailprice", ["key_mod", "p_size", "p_type"], ["p_partkey"], "regression")


def matrix(df):
    return np.array([list(r[0]) for r in df.select(vector_to_array("features")).collect()])


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [(1.0, 3, "b", True), (2.0, 3, "a", False), (None, 3, None, True), (5.0, 3, "c", True), (float("nan"), 3, "a", False)],
        "x double, c int, s string, f boolean")


def test_blocks_fill_scale_encode_and_pass(mixed):
    prep = P.fit_prep(mixed, ["x", "c", "s", "f"])
    assert [n for n, _ in prep.slots()] == ["numeric__x", "numeric__c", "categorical__s_c", "categorical__s_b", "remainder__f"]
    x = np.array([1.0, 2.0, 2.0, 5.0, 2.0])
    got = matrix(prep.transform(mixed))
    assert np.allclose(got[:, 0], (x - x.mean()) / x.std())
    assert np.allclose(got[:, 1], 0)                                   # constant column
    assert got[:, 2].tolist() == [0, 0, 0, 1, 0] and got[:, 3].tolist() == [1, 0, 0, 0, 0]
    assert got[:, 4].tolist() == [1, 0, 1, 1, 0]


def test_unseen_category(spark, mixed):
    new = spark.createDataFrame([(1.0, "zzz"), (1.0, "b")], "x double, s string")
    with pytest.raises(Exception):
        P.fit_prep(mixed, ["x", "s"]).transform(new).collect()
    kept = matrix(P.fit_prep(mixed, ["x", "s"], unseen="keep").transform(new))
    assert kept[0, 1:].tolist() == [0, 0] and kept[1, 1:].tolist() == [0, 1]


def test_missing_and_useless_columns(spark, mixed):
    with pytest.raises(ValueError, match="nope"):
        P.fit_prep(mixed, ["x", "nope"])
    with pytest.raises(ValueError):
        P.fit_prep(spark.range(3).select(F.current_date().alias("d")), ["d"])


def test_odd_names_and_quotes(spark):
    df = spark.createDataFrame([("it's", 1.0), (None, 2.0), ("it's", 3.0), ("b\\c", 4.0)], "`a.b` string, `x y` double")
    prep = P.fit_prep(df, ["a.b", "x y"])
    assert matrix(prep.transform(df))[:, 1].tolist() == [1, 1, 1, 0]


def test_prep_saves_and_loads(spark, mixed):
    prep = P.fit_prep(mixed, ["x", "s", "f"], unseen="keep")
    path = scratch_path(spark, "prep")
    prep.save(path)
    assert np.allclose(matrix(P.Prep.load(path).transform(mixed)), matrix(prep.transform(mixed)))


def test_class_codes_follow_their_own_order(spark):
    df = spark.createDataFrame([(10,), (2,), (2,), (None,)], "y int")
    labels = P.class_list(df, "y")
    assert labels == [2, 10]
    coded = P.decode(P.encode(df, "y", labels), labels, "label")
    assert [(r["label"], r["predicted_label"]) for r in coded.collect()] == [(1, 10), (0, 2), (0, 2), (None, None)]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(300, 3))
    y = x @ [1.5, -2.0, 0.3] + 4 + rng.normal(scale=0.3, size=300)
    rows = [(i, *map(float, r), float(v), float(v > 4)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, y double, z double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache(), x, y


def test_ridge_equals_normal_equations(numbers):
    df, x, y = numbers
    rows = df.withColumn("label", F.col("y"))
    facts = M.training_facts(rows, classification=False)
    for alpha in (1.0, 50.0):
        model = M.build("Ridge", facts, {"alpha": alpha}).fit(rows)
        xc, yc = x - x.mean(axis=0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        assert np.allclose(model.coefficients.toArray(), w, atol=1e-6)


def test_logistic_equals_newton(numbers):
    df, x, y = numbers
    rows = df.withColumn("label", F.col("z"))
    model = M.build("LogisticRegression", M.training_facts(rows)).fit(rows)
    t, w = (y > 4).astype(float), np.zeros(4)
    xb = np.hstack([x, np.ones((300, 1))])
    penalty = np.diag([1.0, 1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xb @ w))
        w -= np.linalg.solve(xb.T @ (xb * (p * (1 - p))[:, None]) + penalty, xb.T @ (p - t) + penalty @ w)
    assert np.allclose([*model.coefficients.toArray(), model.intercept], w, atol=1e-3)


def test_boosted_trees_take_several_classes(numbers):
    df, _, _ = numbers
    rows = df.withColumn("label", (F.col("id") % 3).cast("double"))
    model = M.build("GradientBoostingClassifier", M.training_facts(rows), {"n_estimators": 2}).fit(rows)
    assert model.transform(rows).count() == 300


def test_names(spark):
    assert M.resolve("XGB", "regression") == "XGBRegressor"
    assert M.resolve(" KNN ", "binary_classification") == "KNeighborsClassifier"
    assert M.resolve("nonsense", "multiclass_classification") == "RandomForestClassifier"
    with pytest.raises(ValueError):
        M.resolve("RandomForest", "nlp")
    assert isinstance(M.build("nonsense", M.Facts(1)), type(M.build("RandomForestClassifier", M.Facts(1))))


def test_ward_merge():
    centres = np.array([[0.0], [0.2], [5.0], [5.1], [9.0]])
    groups = ward_merge(centres, np.ones(5), 3)
    assert groups[0] == groups[1] and groups[2] == groups[3] and len(set(groups)) == 3


def test_benchmark_board_has_one_entry_per_model_and_beats_the_majority(spark, folder):
    ready = R.prepare(doc_quality(spark, folder), *DOC)
    board, models = L.benchmark(ready, ["LogisticRegression", "KNeighborsClassifier", "GaussianNB", "MultinomialNB"])
    errors = {r["model"] for r in board.filter("error IS NOT NULL").collect()}
    assert errors == {"MultinomialNB"}                                  # negative values after scaling
    best = L.rank(board, "accuracy").filter("place = 1").first()
    share = ready.test.agg(F.avg("label")).first()[0]
    assert best["value"] >= max(share, 1 - share)
    summary = {r["field"]: r["value"] for r in L.summary(board, "accuracy").collect()}
    assert (summary["total_models_tested"], summary["failed_models"]) == (4, 1)
    for name, trained in models.items():
        path = scratch_path(spark, "saved")
        trained.save(path)
        loaded = R.load_trained(spark, path)
        docs = doc_quality(spark, folder)
        assert loaded.predict(docs).select("doc_id", "prediction").exceptAll(trained.predict(docs).select("doc_id", "prediction")).isEmpty()
        assert "quality" not in loaded.predict(docs).columns


def test_probabilities_sum_to_one(spark, folder):
    trained, report = R.auto_train(doc_quality(spark, folder), *DOC, name="LogisticRegression")
    sums = trained.predict(doc_quality(spark, folder)).select(
        F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, b: a + b).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(sums[0] - 1) < 1e-9 and abs(sums[1] - 1) < 1e-9
    sizes = {r["metric"]: r["value"] for r in report.filter("section = 'training'").collect()}
    assert sizes["train_samples"] + sizes["test_samples"] == doc_quality(spark, folder).count()


def test_regression_report_and_best_model(spark, folder):
    trained, report = R.train_model(part_price(spark, folder), *PART, name="LinearRegression")
    values = {r["metric"]: r["value"] for r in report.collect()}
    assert values["test_score"] > 0.99 and values["cv_mean"] > 0.99 and values["train_samples"] == 160
    loaded, result = L.train_best(part_price(spark, folder), *PART[:3], scratch_path(spark, "best"))
    row = result.first()
    assert row["task_type"] == "regression" and row["models_tested"] == 6 and loaded.name == row["best_model_name"]


def test_clustering_benchmark(spark, folder):
    task, board, _, _ = L.run_benchmark(part_price(spark, folder), "p_retailprice", ["key_mod", "p_size"], ["p_partkey"], "clustering")
    assert board.filter("metric = 'n_clusters' AND value = 3").count() == 2 and board.filter("error IS NOT NULL").isEmpty()


def test_tuning(spark, folder):
    table = U.tune(part_price(spark, folder), *PART, "Ridge", grid={"alpha": [0.1, 1000.0]}, cv_folds=3).collect()
    assert len(table) == 2 and table[0]["params"] == "{'alpha': 0.1}"
    assert U.settings("Ridge", "random", 2) == U.settings("Ridge", "random", 2)
    with pytest.raises(ValueError):
        U.settings("Ridge", "other")
