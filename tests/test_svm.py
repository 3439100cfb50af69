"""Support vector machines: how far the dual problem shows them to be from the best one."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, StructField, StructType

from tabml.operators import svm
from tabml.operators.svm import KernelMachine, SupportVectors

SCHEMA = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])


def frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], SCHEMA).repartition(3)


def drawn(kind, n=300):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + 0.1 * rng.normal(size=n)
    return x, {"number": y, "two": (y > 1).astype(float), "three": np.digitize(y, [0.3, 1.2]).astype(float)}[kind]


def gap(kind, machine, x, y, penalty=1.0, tube=0.1):
    """(loss, distance from the best loss) of the first column, by a point of the dual problem: alpha from the slopes
    of the smoothed loss lies in its box, and the intercept's optimality makes it balance."""
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    kernel, f = np.exp(-machine.gamma * square), machine.outputs(x)[:, 0]
    t = svm.targets(kind, y, 1)[:, 0]
    w = np.array(machine.weights)[0, :-1]
    loss = svm.losses(kind, f, t, tube, 1e-12)[0].sum() * penalty + w @ w / 2
    scale = y.std() if kind == "number" else 1.0
    alpha = -penalty * svm.losses(kind, f, t, tube, svm.SMOOTH[-1] * scale)[1]
    assert abs(alpha.sum()) < 1e-3 * penalty * len(x)
    linear = alpha @ t - tube * np.abs(alpha).sum() if kind == "number" else (alpha * t).sum()
    return loss, loss - (linear - alpha @ kernel @ alpha / 2)


@pytest.mark.parametrize("kind", ["number", "two"])
def test_machines_are_as_good_as_the_dual_allows(spark, kind):
    x, y = drawn(kind)
    machine = SupportVectors(kind).fit(frame(spark, x, y))
    assert machine.settings["landmarks"] == 300
    loss, distance = gap(kind, machine, x, y)
    assert 0 <= distance + 1e-6 and distance < 2e-3 * loss


def test_three_classes_and_saving(spark, tmp_path):
    x, y = drawn("three")
    df = frame(spark, x, y)
    machine = SupportVectors("three", classes=3).fit(df)
    rows = machine.transform(df).collect()
    assert np.mean([r.prediction == r.label for r in rows]) > 0.8
    machine.save(str(tmp_path / "m"))
    again = KernelMachine.load(str(tmp_path / "m"))
    assert [r.prediction for r in again.transform(df).collect()] == [r.prediction for r in rows]


def test_more_landmarks_fit_better(spark):
    x, y = drawn("number")
    losses = [gap("number", SupportVectors("number", landmarks=m).fit(frame(spark, x, y)), x, y)[0] for m in (5, 60)]
    assert losses[1] < losses[0]


def test_one_row_and_one_class(spark):
    one = SupportVectors("number").fit(frame(spark, np.array([[1.0, 2.0]]), np.array([5.0])))
    assert abs(one.outputs(np.array([[1.0, 2.0]]))[0, 0] - 5) <= 0.11
    same = SupportVectors("two").fit(frame(spark, np.array([[1.0], [2.0]]), np.array([0.0, 0.0])))
    assert [r.prediction for r in same.transform(frame(spark, np.array([[1.5]]), np.array([0.0]))).collect()] == [0.0]


def test_copies_of_rows_are_merged(spark):
    x, y = drawn("number", 40)
    few, many = frame(spark, x, y), frame(spark, np.repeat(x, 50, axis=0), np.repeat(y, 50))
    with svm.packed(many, 2000) as cells:
        merged = [(np.frombuffer(r["y"]), np.frombuffer(r["times"])) for r in cells.collect()]
    assert sum(len(a) for a, _ in merged) == 40 and all((b == 50).all() for _, b in merged)
    one, other = SupportVectors("number", penalty=50.0).fit(few), SupportVectors("number", penalty=1.0).fit(many)
    assert abs(one.gamma / other.gamma - 1) < 1e-9
    losses = [gap("number", m, np.repeat(x, 50, axis=0), np.repeat(y, 50))[0] for m in (one, other)]
    assert abs(losses[0] / losses[1] - 1) < 1e-4


def test_rows_are_not_whitened_to_be_scored(spark):
    """The same outputs as from whitened kernel values."""
    x, y = drawn("number", 60)
    machine = SupportVectors("number", landmarks=30).fit(frame(spark, x, y))
    landmarks, weights = np.array(machine.landmarks), np.array(machine.weights)
    kernel, whiten = svm.kernel_values(x, landmarks, machine.gamma), svm.whitening(landmarks, machine.gamma)
    told = np.hstack([kernel @ whiten, np.ones((60, 1))]) @ weights.T
    assert np.allclose(machine.outputs(x), told, atol=1e-6) and np.allclose(kernel, np.exp(-machine.gamma * ((x[:, None] - landmarks) ** 2).sum(axis=2)))
