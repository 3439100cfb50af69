"""Hierarchical (Ward) clustering at scale: k-means micro-clusters on Spark, merged by Ward's rule.

Only the micro-cluster centres and sizes (at most ``micro``) reach the driver; the merge
order depends on nothing else, since Ward's cost of two groups follows from their means and
sizes. Rows are labelled through the micro-cluster they belong to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.session import read_json, write_json


def ward_merge(centres: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Group number 0..k-1 per centre after merging the cheapest pair until k groups are left."""
    members = [[i] for i in range(len(centres))]
    means, weight = [c for c in centres.astype(float)], list(sizes.astype(float))
    while len(members) > k:
        m, w = np.array(means), np.array(weight)
        gap = ((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2) * (w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
        gap[np.tril_indices(len(m))] = np.inf
        a, b = np.unravel_index(gap.argmin(), gap.shape)
        means[a] = (means[a] * weight[a] + means[b] * weight[b]) / (weight[a] + weight[b])
        weight[a] += weight[b]
        members[a] += members[b]
        del means[b], weight[b], members[b]
    groups = np.zeros(len(centres), dtype=int)
    for g, rows in enumerate(sorted(members, key=min)):
        groups[rows] = g
    return groups


@dataclass
class WardModel:
    micro: KMeansModel
    groups: list[int]

    def transform(self, prepared: DataFrame) -> DataFrame:
        coded = self.micro.transform(prepared)
        return coded.withColumn("prediction", F.try_element_at(F.lit(self.groups), F.col("prediction") + 1))

    def save(self, path: str) -> None:
        self.micro.save(f"{path}/micro")
        write_json(f"{path}/groups", self.groups)

    @classmethod
    def load(cls, path: str) -> WardModel:
        return cls(KMeansModel.load(f"{path}/micro"), read_json(f"{path}/groups"))


@dataclass
class WardClusters:
    k: int = 3
    micro: int = 200
    seed: int = 42

    def fit(self, prepared: DataFrame) -> WardModel:
        model = KMeans(k=self.micro, seed=self.seed).fit(prepared)
        centres = np.array(model.clusterCenters())
        counted = {r["prediction"]: r["n"] for r in model.transform(prepared).groupBy("prediction").agg(
            F.count(F.lit(1)).alias("n")).collect()}
        sizes = np.array([max(1, counted.get(i, 0)) for i in range(len(centres))])
        return WardModel(model, ward_merge(centres, sizes, self.k).tolist())
