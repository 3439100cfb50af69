"""Boosting against a plain version that looks at every cut of every node."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, StructField, StructType

from tabml.operators import boost
from tabml.operators.boost import Boosted, Boosting, Settings


SCHEMA = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])


def derivatives(s, margins, y):
    if s.objective == "squared":
        return margins - y[:, None], np.ones_like(margins)
    if s.objective == "logistic":
        p = 1 / (1 + np.exp(-margins))
        return p - y[:, None], p * (1 - p)
    p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
    return p - np.eye(margins.shape[1])[y.astype(int)], (2 if s.newton else 1) * p * (1 - p)


def plain_tree(s, x, g, h, edges, factor):
    """Leaf value of every row; cuts are tried one by one."""
    def score(rows):
        weight = h[rows].sum() + s.l2 if s.newton else len(rows)
        return g[rows].sum() ** 2 / weight if weight > 0 else 0.0

    def grow(rows, depth):
        value = -factor * g[rows].sum() / (h[rows].sum() + s.l2)
        best = None
        if depth < s.depth:
            for f, cuts in enumerate(edges):
                missing = np.isnan(x[rows, f])
                for e in cuts:
                    for side in ((False, True) if missing.any() else (None,)):
                        goes = np.where(missing, bool(side), x[rows, f] <= e)
                        a, b = rows[goes], rows[~goes]
                        if len(a) and len(b) and min(h[a].sum(), h[b].sum()) >= s.least_hessian:
                            gain = score(a) + score(b) - score(rows)
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, a, b)
        if best is None or best[0] <= max(s.least_gain, 1e-12):
            out[rows] = value
            return
        grow(best[1], depth + 1)
        grow(best[2], depth + 1)
    out = np.zeros(len(x))
    grow(np.arange(len(x)), 0)
    return out


def plain(s, x, y, edges, base):
    margins = np.tile(np.array(base), (len(x), 1))
    factor = s.step if s.newton or s.objective != "softmax" else s.step * (s.classes - 1) / s.classes
    for _ in range(s.rounds):
        g, h = derivatives(s, margins, y)
        margins = margins + np.stack([plain_tree(s, x, g[:, k], h[:, k], edges, factor) for k in range(margins.shape[1])], axis=1)
    return margins


def rows(spark, x, y, parts=3):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], SCHEMA).repartition(parts)


def drawn(kind, n=140, missing=0.15):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[:, 2] = rng.integers(0, 2, n)
    x[rng.random((n, 3)) < missing] = np.nan
    signal = np.nan_to_num(x[:, 0], nan=1.5) - 2 * np.nan_to_num(x[:, 2], nan=-0.5) + 0.3 * rng.normal(size=n)
    y = {"squared": 10 * signal, "logistic": (signal > 0).astype(float), "softmax": np.digitize(signal, [-1, 0.5]).astype(float)}[kind]
    return x, y


@pytest.mark.parametrize("kind,classes", [("squared", 1), ("logistic", 1), ("softmax", 3)])
@pytest.mark.parametrize("newton", [True, False])
def test_two_rounds_equal_the_plain_version(spark, kind, classes, newton):
    x, y = drawn(kind)
    s = Settings(kind, classes, rounds=2, depth=2, bins=12, newton=newton, l2=1.0 if newton else 0.0, least_hessian=1.0 if newton else 0.0)
    model = Boosting(s).fit(rows(spark, x, y))
    want = plain(s, x, y, model.edges, model.base)
    got = boost.margins_of(model.trees, model.base, boost.binned(x, model.edges))
    assert np.abs(got - want).max() < 1e-9
    out = model.transform(rows(spark, x, y, 1)).collect()
    if kind == "squared":
        assert [r.prediction for r in out] == pytest.approx(want[:, 0].tolist(), abs=1e-9)
    else:
        assert np.array([r.probability.toArray() for r in out]).sum(axis=1) == pytest.approx(1.0)
        assert [r.prediction for r in out] == [float(r.probability.toArray().argmax()) for r in out]


def test_trees_do_not_depend_on_the_number_of_tasks(spark):
    x, y = drawn("softmax")
    s = Settings("softmax", 3, rounds=3, depth=3, bins=20)
    models = [Boosting(s).fit(rows(spark, x, y, parts)) for parts in (1, 7)]
    assert models[0] == models[1]


def test_levels_by_jobs_and_groups_give_the_same_trees(spark, monkeypatch):
    x, y = drawn("softmax")
    s = Settings("softmax", 3, rounds=2, depth=3, bins=20)
    in_groups = Boosting(s).fit(rows(spark, x, y))
    for cells in (0, 150):
        monkeypatch.setattr(boost, "GROUP_CELLS", cells)
        assert predictions(Boosting(s).fit(rows(spark, x, y)), x) == predictions(in_groups, x)


def predictions(model, x):
    return boost.margins_of(model.trees, model.base, boost.binned(x, model.edges)).tolist()


def test_nodes_in_several_passes_and_stored_margins(spark, monkeypatch):
    x, y = drawn("logistic")
    s = Settings("logistic", 1, rounds=5, depth=3, bins=10)
    whole = Boosting(s).fit(rows(spark, x, y))
    monkeypatch.setattr(boost, "HISTOGRAM_CELLS", 1)
    monkeypatch.setattr(boost, "KEPT_ROUNDS", 2)
    assert Boosting(s).fit(rows(spark, x, y)) == whole
    monkeypatch.setattr(boost, "GROUP_CELLS", 100)
    assert predictions(Boosting(s).fit(rows(spark, x, y)), x) == predictions(whole, x)


def test_boosting_learns_saves_and_ranks_features(spark, tmp_path):
    x, y = drawn("squared", 400, 0.0)
    model = Boosting(Settings("squared", rounds=30, depth=3)).fit(rows(spark, x, y))
    got = np.array([r.prediction for r in model.transform(rows(spark, x, y, 1)).collect()])
    assert 1 - ((got - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.97
    assert model.featureImportances.toArray().argmin() == 1 and model.featureImportances.toArray().sum() == pytest.approx(1)
    model.save(str(tmp_path / "model"))
    assert Boosted.load(str(tmp_path / "model")) == model


def test_nothing_to_learn(spark):
    one = Boosting(Settings("squared", rounds=2)).fit(rows(spark, [[1.0, float("nan")]], [5.0], 1))
    assert [r.prediction for r in one.transform(rows(spark, [[2.0, 0.0]], [0.0], 1)).collect()] == [5.0]
    same = Boosting(Settings("logistic", rounds=2)).fit(rows(spark, [[1.0], [2.0], [3.0]], [0.0, 0.0, 0.0], 1))
    assert [r.prediction for r in same.transform(rows(spark, [[2.0]], [0.0], 1)).collect()] == [0.0]
    none = Boosting(Settings("squared", rounds=2)).fit(spark.createDataFrame([], SCHEMA))
    assert none.trees == [] and none.base == [0.0]


def test_a_pass_has_few_tasks_whatever_the_input_is_split_into(spark, monkeypatch):
    rows = spark.createDataFrame([(Vectors.dense([float(i % 17), float(i % 5)]), float(i % 11)) for i in range(3000)], ["features", "label"])
    seen, own = [], Boosting._round

    def spied(self, state, *rest):
        seen.append((state.rdd.getNumPartitions(), state.count()))
        return own(self, state, *rest)
    monkeypatch.setattr(Boosting, "_round", spied)
    want = Boosting(Settings("squared", rounds=4, depth=3)).fit(rows.coalesce(1)).trees
    monkeypatch.setattr(boost, "CHUNK_ROWS", 7)
    monkeypatch.setattr(boost, "KEPT_ROUNDS", 3)
    assert Boosting(Settings("squared", rounds=4, depth=3)).fit(rows.repartition(50)).trees == want
    cores = spark.sparkContext.defaultParallelism
    assert all(n <= cores for n, _ in seen) and seen[0][1] <= 2 < 3000 // 7 <= seen[-1][1] < 3000


def test_plans_do_not_grow_from_round_to_round(spark, monkeypatch):
    x, y = drawn("squared")
    seen, own = [], Boosting._round

    def spied(self, state, *rest):
        trees = own(self, state, *rest)
        seen.append(len(state._jdf.queryExecution().toString()))
        return trees
    monkeypatch.setattr(Boosting, "_round", spied)
    Boosting(Settings("squared", rounds=7, depth=1)).fit(rows(spark, x, y))
    assert len(seen) == 7 and max(seen) < 1.2 * min(seen)


def test_trees_of_jobs_and_of_groups_hold_plain_numbers(spark, monkeypatch):
    x, y = drawn("squared")
    for cells in (0, 1 << 22):
        monkeypatch.setattr(boost, "GROUP_CELLS", cells)
        model = Boosting(Settings("squared", rounds=1, depth=2)).fit(rows(spark, x, y))
        tree = model.trees[0][0]
        assert len(tree.feature) > 3 and {type(v) for v in [*tree.value, *tree.cover, *tree.gain]} == {float}


def test_rows_without_features_have_the_base_alone(spark):
    model = Boosting(Settings("squared", rounds=2)).fit(rows(spark, [[], []], [1.0, 3.0], 1))
    assert model.trees == [] and model.base == [2.0]
