"""Contributions of trees against sums over all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tabml.operators import tree_paths as P
from tabml.operators.boost import Boosting, Settings, binned, margins_of


def drawn_tree(rng, features, depth):
    """A tree of random cuts; features repeat along paths."""
    tree = {name: [] for name in ("feature", "threshold", "missing_left", "left", "right", "cover", "value")}

    def grow(level, cover):
        at = len(tree["feature"])
        leaf = level == depth or cover < 2 or rng.random() < 0.1
        for name, value in (("feature", -1 if leaf else int(rng.integers(features))), ("threshold", float(rng.normal())), ("missing_left", bool(rng.integers(2))),
                            ("left", -1), ("right", -1), ("cover", float(cover)), ("value", float(rng.normal()))):
            tree[name].append(value)
        if not leaf:
            part = int(rng.integers(1, cover)) if cover > 1 else 1
            tree["left"][at] = grow(level + 1, part)
            tree["right"][at] = grow(level + 1, cover - part)
        return at
    grow(0, 100)
    return tree


def known(tree, x, subset, node=0):
    """Expected output when only the features of the subset are known."""
    f = tree["feature"][node]
    if f < 0:
        return tree["value"][node]
    left, right = tree["left"][node], tree["right"][node]
    if f in subset:
        goes = tree["missing_left"][node] if np.isnan(x[f]) else x[f] <= tree["threshold"][node]
        return known(tree, x, subset, left if goes else right)
    a, b = tree["cover"][left], tree["cover"][right]
    return (a * known(tree, x, subset, left) + b * known(tree, x, subset, right)) / (a + b)


def brute_force(trees, x):
    d = len(x)
    value = {s: sum(known(t, x, s) for t in trees) for k in range(d + 1) for s in combinations(range(d), k)}
    out = np.zeros(d)
    for f in range(d):
        for k in range(d):
            for s in combinations([g for g in range(d) if g != f], k):
                out[f] += factorial(k) * factorial(d - k - 1) / factorial(d) * (value[tuple(sorted((*s, f)))] - value[s])
    return out, value[()]


@pytest.mark.parametrize("features,depth", [(2, 1), (3, 4), (8, 7)])
def test_paths_equal_sums_over_subsets(features, depth, monkeypatch):
    monkeypatch.setattr(P, "CELLS", 40)
    rng = np.random.default_rng(features)
    trees = [drawn_tree(rng, features, depth) for _ in range(2)]
    x = rng.normal(size=(5, features))
    x[0, 0] = x[3, 1] = np.nan
    paths = P.paths_of(trees, 0.0)
    got = P.contributions(x, paths)
    for row, own in zip(x, got):
        want, base = brute_force(trees, row)
        assert own == pytest.approx(want, abs=1e-10) and paths.expected == pytest.approx(base, abs=1e-10)


SCHEMA = StructType([StructField("id", LongType()), StructField("features", VectorUDT()), StructField("label", DoubleType())])


def frame(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 4)).round(2)
    x[:, 3] = rng.integers(0, 2, 150)
    y = x[:, 0] * x[:, 3] + x[:, 1]
    y = {"number": y, "two": (y > 0).astype(float), "three": np.digitize(y, [-0.5, 0.6]).astype(float)}[kind]
    return spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], SCHEMA), x


@pytest.mark.parametrize("make,kind,k", [
    (lambda: R.DecisionTreeRegressor(maxDepth=4), "number", 0), (lambda: R.RandomForestRegressor(numTrees=4, maxDepth=5, seed=1), "number", 0),
    (lambda: C.DecisionTreeClassifier(maxDepth=3), "three", 2), (lambda: C.RandomForestClassifier(numTrees=5, maxDepth=4, seed=1), "two", 1)])
def test_contributions_add_up_to_the_output_of_spark_models(spark, make, kind, k):
    df, x = frame(spark, kind)
    model = make().fit(df)
    rows = P.shapley_trees(df, ["id"], P.model_paths(model, k), ["a", "b", "c", "d"]).collect()
    assert len(rows) == 600 and {r.feature for r in rows} == set("abcd")
    total = {i: 0.0 for i in range(150)}
    for r in rows:
        total[r.id] += r.contribution + r.base_value / 4
    for r in model.transform(df).collect():
        assert total[r.id] == pytest.approx(r.prediction if kind == "number" else float(r.probability[k]), abs=1e-9)


@pytest.mark.parametrize("objective,classes,kind", [("squared", 1, "number"), ("logistic", 1, "two"), ("softmax", 3, "three")])
def test_contributions_of_boosted_trees(spark, objective, classes, kind):
    df, x = frame(spark, kind)
    model = Boosting(Settings(objective, classes, rounds=4, depth=3, bins=30)).fit(df)
    k = classes - 1
    paths = P.model_paths(model, k)
    got = P.contributions(x, paths)
    want = margins_of(model.trees, model.base, binned(x, model.edges))[:, k]
    assert got.sum(axis=1) + paths.expected == pytest.approx(want, abs=1e-9)
    trees, base = P._boosted_trees(model, k)
    assert got[7] == pytest.approx(brute_force(trees, x[7])[0], abs=1e-10)


def test_other_models_have_no_paths(spark):
    df, _ = frame(spark, "number")
    assert P.model_paths(R.LinearRegression().fit(df)) is None
