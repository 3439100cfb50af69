"""Multinomial naive Bayes against the closed form."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabml.operators.bayes import BayesModel
from tabml.operators.models import Facts, build
from tabml.session import scratch_path

ROWS = [(0, [3.0, 1.0, 0.0])] + [(1, [float(i % 4), 2.0, 1.0]) for i in range(40)] + [(3, [0.0, 0.0, 2.0])] * 3


def _rows(spark, rows):
    return spark.createDataFrame([(float(y), Vectors.dense(x)) for y, x in rows], ["label", "features"])


def test_priors_are_the_shares_of_the_classes(spark):
    model = build("MultinomialNB", Facts(0)).fit(_rows(spark, ROWS))
    y, x = np.array([r[0] for r in ROWS]), np.array([r[1] for r in ROWS])
    want = np.full((len(x), 4), -np.inf)
    for k in (0, 1, 3):
        sums = x[y == k].sum(axis=0)
        want[:, k] = np.log((y == k).mean()) + x @ np.log((sums + 1) / (sums.sum() + 3))
    want = np.exp(want) / np.exp(want).sum(axis=1, keepdims=True)
    for fitted in (model, _reloaded(spark, model)):
        scored = fitted.transform(_rows(spark, ROWS)).collect()
        assert np.allclose([r.probability.toArray() for r in scored], want, atol=1e-12)
        assert [int(r.prediction) for r in scored] == want.argmax(axis=1).tolist()


def _reloaded(spark, model):
    path = scratch_path(spark, "bayes")
    model.save(path)
    return BayesModel.load(path)


def test_a_row_that_only_unsmoothed_priors_tell(spark):
    rows = [(0, [2.0, 1.0])] + [(1, [1.0, 2.0])] * 9
    model = build("MultinomialNB", Facts(0)).fit(_rows(spark, rows))
    # class 0: 1/10 * (3/5)^a * (2/5)^b, class 1: 9/10 * (10/29)^a * (19/29)^b; smoothed priors would be 2/12 and 10/12
    assert [r.prediction for r in model.transform(_rows(spark, [(0, [3.0, 0.0]), (0, [5.0, 0.0])])).collect()] == [1.0, 0.0]


def test_negative_values_and_empty_texts(spark):
    with pytest.raises(ValueError):
        build("MultinomialNB", Facts(0)).fit(_rows(spark, [(0, [-1.0]), (1, [1.0])]))
    model = build("MultinomialNB", Facts(0)).fit(_rows(spark, ROWS))
    assert model.transform(_rows(spark, [(0, [0.0, 0.0, 0.0])])).first().prediction == 1.0
