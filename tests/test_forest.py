"""The forest against a plain version with the same draws that looks at every cut of every node."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from checks.modelling import PART
from checks.tables import part_price
from tabml.operators import boost, forest
from tabml.operators.forest import Forest, RandomForest
from tabml.plans import train as R

SCHEMA = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])


def table(n=120, seed=3):
    """A number, a number of few values and a one-hot block; some rows repeat."""
    dice = np.random.default_rng(seed)
    x = np.zeros((n, 7))
    x[:, 0], x[:, 1] = dice.normal(size=n).round(2), dice.integers(0, 4, n)
    x[np.arange(n), 2 + dice.integers(0, 5, n)] = 1
    y = 3 * x[:, 0] + x[:, 3] + dice.integers(0, 9, n) / 4
    return np.concatenate([x, x[:n // 3]]), np.concatenate([y, y[:n // 3]])


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y)], SCHEMA).repartition(parts)


def distinct(spark, model, x, y):
    """(rows, labels, times, hashes) of the merged rows, as the fit sees them."""
    cells = forest.cells_of(x, model.edges)
    rows = spark.createDataFrame([(a, float(b)) for a, b in zip(x.tolist(), y)], "values array<double>, label double").repartition(1)
    told = rows.mapInArrow(forest._sparse(model.edges, cells), "cells binary, label double").groupBy("cells", "label").count()
    first = {}
    for r in told.withColumn("hash", F.xxhash64("cells", "label")).orderBy("count").collect():
        first[bytes(r["cells"]), r["label"]] = (r["count"], r["hash"])
    bins, out = forest._held(x, model.edges), {}
    for a, b, y1 in zip(bins, x, y):
        at = np.flatnonzero(a != cells.usual)
        out[(cells.start[at] + a[at]).astype("<i4").tobytes(), float(y1)] = b
    order = sorted(out, key=lambda k: first[k][0])
    return (np.array([out[k] for k in order]), np.array([k[1] for k in order]), np.array([first[k][0] for k in order]),
            np.array([first[k][1] for k in order], np.int64))


def plain_tree(x, y, w, edges, depth):
    """Mean of every drawn row's leaf; all rows follow the same cuts."""
    out = np.zeros(len(x))

    def grow(rows, depth):
        own = rows[w[rows] > 0]
        mean = np.average(y[own], weights=w[own])
        best = None
        for f, cuts in enumerate(edges if depth and w[own].sum() > 1 else []):
            for e in cuts:
                left, right = own[x[own, f] <= e], own[x[own, f] > e]
                if len(left) and len(right):
                    spread = lambda r: np.average((y[r] - np.average(y[r], weights=w[r])) ** 2, weights=w[r]) * w[r].sum()
                    gain = spread(own) - spread(left) - spread(right)
                    if best is None or gain > best[0] + 1e-6:
                        best = (gain, f, e)
        if best is None or best[0] < 1e-6:
            out[rows] = mean
            return
        grow(rows[x[rows, best[1]] <= best[2]], depth - 1)
        grow(rows[x[rows, best[1]] > best[2]], depth - 1)
    grow(np.arange(len(x)), depth)
    return out


def test_trees_match_the_plain_ones(spark):
    x, y = table()
    model = RandomForest(4, 5, 64).fit(frame(spark, x, y))
    rows, labels, times, hashes = distinct(spark, model, x, y)
    assert times.max() > 1 and times.sum() == len(x)
    got = boost.binned(rows, model.edges)
    for t, [tree] in enumerate(model.trees):
        w = forest.draws(hashes, times, t)
        wanted = plain_tree(rows, labels, w, model.edges, 5)
        assert tree.cover[0] == w.sum()
        assert np.allclose(model.base[0] + 4 * tree.leaves(got), wanted, atol=1e-6)


def test_trees_depend_on_nothing_but_the_rows(spark, monkeypatch, tmp_path):
    x, y = table(seed=4)
    model = RandomForest(5, 6, 16).fit(frame(spark, x, y))
    for name, value in (("PASS_CELLS", 1), ("ITEM_CELLS", 200), ("CHUNK_ROWS", 7)):
        monkeypatch.setattr(forest, name, value)
    other = RandomForest(5, 6, 16).fit(frame(spark, x[::-1], y[::-1], 5))
    assert np.allclose(model.featureImportances.toArray(), other.featureImportances.toArray())
    bins = boost.binned(x, model.edges)
    assert model.edges == other.edges and np.allclose(boost.margins_of(model.trees, model.base, bins), boost.margins_of(other.trees, other.base, bins))
    model.save(str(tmp_path / "model"))
    assert Forest.load(str(tmp_path / "model")) == model


@pytest.mark.parametrize("count", [1, 3, 60, 4000])
def test_draws_are_poisson(count):
    hashes = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, 40_000)
    got = forest.draws(hashes, np.full(len(hashes), count), 7)
    assert abs(got.mean() - count) < 5 * (count / len(hashes)) ** 0.5 and abs(got.var() / count - 1) < 0.05
    assert abs(np.corrcoef(got, forest.draws(hashes, np.full(len(hashes), count), 8))[0, 1]) < 0.03


def test_edges_of_the_input(spark):
    assert RandomForest(2).fit(frame(spark, np.zeros((1, 2)), [3.0], 1)).trees[0][0].feature == [-1]
    same = RandomForest(3).fit(frame(spark, np.ones((9, 2)), np.arange(9.0)))
    assert [t.feature for [t] in same.trees] == [[-1]] * 3 and same.featureImportances.toArray().tolist() == [0.0, 0.0]
    none = RandomForest(2).fit(spark.createDataFrame([], SCHEMA))
    assert none.trees == [] and none.base == [0.0]


def test_rows_are_kept_sparse_and_merged(spark, folder, monkeypatch):
    """A one-hot block of many levels costs one cell a row, and copies of the table cost no more rows."""
    ready = R.prepare(part_price(spark, folder), *PART)
    seen = []
    packed = forest._packed

    def spy(cells, mean, bits):
        seen.append(cells)
        return packed(cells, mean, bits)
    monkeypatch.setattr(forest, "_packed", spy)
    trained = R.fit_model(ready, "RandomForestRegressor", {"n_estimators": 3})
    assert isinstance(trained.model, Forest)
    rows = ready.train.select(forest.vector_to_array("features").alias("values"), "label")
    sparse = rows.mapInArrow(forest._sparse(trained.model.edges, seen[0]), "cells binary, label double")
    assert len(trained.model.edges) > 3 and sparse.agg(F.max(F.length("cells"))).first()[0] <= 3 * 4
    assert sparse.union(sparse).groupBy("cells", "label").count().count() <= rows.count()
