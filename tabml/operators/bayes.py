"""Multinomial naive Bayes with the classes' own shares as priors: only feature counts are smoothed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.session import read_json, write_json


@dataclass
class BayesModel:
    """Log of the share per class, and of each feature's share within it (-inf: a class without rows)."""

    alpha: float
    prior: list
    shares: list

    @property
    def numFeatures(self) -> int:
        return len(self.shares[0]) if self.shares else 0

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` and ``prediction``; of equal classes the first."""
        prior, shares = np.array(self.prior, float), np.array(self.shares, float)

        @F.pandas_udf("array<double>")
        def outputs(x):
            import pandas as pd

            if not len(x):
                return pd.Series([], dtype=object)
            values = np.stack(x.to_numpy()).astype(float)
            logs = np.tile(prior, (len(values), 1))
            for j in range(values.shape[1]):
                logs += values[:, j:j + 1] * shares[:, j]
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            best = logs.argmax(axis=1).astype(float)               # before exp, which makes near classes equal
            return pd.Series(list(np.column_stack([p / p.sum(axis=1, keepdims=True), best])))
        classes = len(prior)
        out = df.withColumn("_outputs", outputs(vector_to_array("features")))
        out = out.withColumn("probability", array_to_vector(F.slice("_outputs", 1, classes)))
        return out.withColumn("prediction", F.col("_outputs")[classes]).drop("_outputs")

    def save(self, path: str) -> None:
        write_json(path, [self.alpha, self.prior, self.shares])

    @classmethod
    def load(cls, path: str) -> BayesModel:
        return cls(*read_json(path))


@dataclass
class MultinomialBayes:
    """Fits ``features`` (a vector of counts) and ``label`` (a class code from 0)."""

    alpha: float = 1.0

    def fit(self, prepared: DataFrame) -> BayesModel:
        found = prepared.groupBy(F.col("label").cast("int").alias("label")).agg(
            F.count("*").alias("n"), Summarizer.sum(F.col("features")).alias("sums"), Summarizer.min(F.col("features")).alias("least"))
        rows = {r["label"]: r for r in found.collect()}                              # a row per class
        if any(not (r["least"].toArray() >= 0).all() for r in rows.values()):
            raise ValueError("multinomial naive Bayes needs values that are not negative")
        n = sum(r["n"] for r in rows.values())
        prior, shares = [], []
        for k in range(max(rows, default=-1) + 1):
            sums = rows[k]["sums"].toArray() if k in rows else np.zeros(rows[max(rows)]["sums"].size)
            prior.append(float(np.log(rows[k]["n"] / n)) if k in rows else float("-inf"))
            shares.append(np.log((sums + self.alpha) / (sums.sum() + self.alpha * len(sums))).tolist())
        return BayesModel(self.alpha, prior, shares)
