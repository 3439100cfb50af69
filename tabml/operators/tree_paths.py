"""Exact contributions of features to the outputs of trees (Lundberg et al. 2020), from a table of leaf paths.

A leaf's path holds, for each feature on it, the interval of values that lead on and the share of training
rows that do. A row's output with only some features known is a sum over leaves of products, one
factor a feature: 1 or 0 for a known feature, the share for an unknown one. The Shapley value of such a
product is an integral over a polynomial, which Gauss-Legendre nodes give without error, so nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.functions.columns import col
from tabml.operators.boost import Boosted
from tabml.session import scratch_path

CELLS = 1 << 21      # rows times leaves times features on a path that are looked at together


@dataclass(frozen=True)
class Paths:
    """Leaves with ``m`` features on their path, for every m: (features, low, high, missing, share, value), where a
    value leads on from above ``low`` up to ``high``; ``base`` is added to all outputs."""

    groups: tuple
    base: float

    @property
    def expected(self) -> float:
        """The output with no feature known."""
        return self.base + sum(float((share.prod(axis=1) * value).sum()) for *_, share, value in self.groups)


def paths_of(trees: list[dict], base: float) -> Paths:
    """Trees as arrays: feature (-1 in leaves), threshold (up to it goes left), missing_left, left, right, cover, value."""
    found: dict[int, list] = {}
    for tree in trees:
        open_nodes: list = [(0, {})]
        while open_nodes:
            node, path = open_nodes.pop()
            f = tree["feature"][node]
            if f < 0:
                own = [(k, *v) for k, v in sorted(path.items())]
                found.setdefault(len(own), []).append((own, tree["value"][node]))
                continue
            low, high, missing, share = path.get(f, (-np.inf, np.inf, True, 1.0))
            cut, side = tree["threshold"][node], tree["missing_left"][node]
            for child, span, own in ((tree["left"][node], (low, min(high, cut)), missing and side), (tree["right"][node], (max(low, cut), high), missing and not side)):
                part = tree["cover"][child] / tree["cover"][node] if tree["cover"][node] else 0.5
                open_nodes.append((child, path | {f: (*span, own, share * part)}))
    groups = []
    for m, leaves in sorted(found.items()):
        columns = [np.array([[step[i] for step in own] for own, _ in leaves], kind).reshape(len(leaves), m)
                   for i, kind in enumerate((np.int64, float, float, bool, float))]
        groups.append((*columns, np.array([value for _, value in leaves], float)))
    return Paths(tuple(groups), float(base))


def contributions(x: np.ndarray, paths: Paths) -> np.ndarray:
    """(rows, features): they and ``expected`` add up to the output. NaN is missing."""
    out = np.zeros((x.shape[1], len(x)))
    for features, low, high, missing, share, value in paths.groups:
        m = features.shape[1]
        if not m:
            continue
        nodes, weights = np.polynomial.legendre.leggauss(m // 2 + 1)
        nodes, weights = (nodes + 1) / 2, weights / 2
        step = max(1, CELLS // max(1, len(x) * m))
        for start in range(0, len(value), step):
            part = slice(start, start + step)
            own = x[:, features[part]]
            z = np.where(np.isnan(own), missing[part], (own > low[part]) & (own <= high[part])).astype(float)
            r, others = share[part], np.zeros_like(z)
            for t, w in zip(nodes, weights):
                factors = t * z + (1 - t) * r
                before, behind = np.ones_like(z), np.ones_like(z)
                before[..., 1:] = np.cumprod(factors[..., :-1], axis=2)
                behind[..., :-1] = np.cumprod(factors[..., :0:-1], axis=2)[..., ::-1]
                others += w * before * behind
            shares = (z - r) * others * value[part][None, :, None]
            np.add.at(out, features[part].ravel(), shares.reshape(len(x), -1).T)
    return out.T


def _boosted_trees(model: Boosted, class_index: int) -> tuple[list[dict], float]:
    """Margins: of the second class where there are two, of one class where there are more."""
    k = 0 if model.settings.objective != "softmax" else class_index
    trees = []
    for t in (r[k] for r in model.trees):
        cuts = [model.edges[f][c] if f >= 0 and c < len(model.edges[f]) else np.inf for f, c in zip(t.feature, t.cut)]
        trees.append({"feature": t.feature, "threshold": cuts, "missing_left": t.missing_left, "left": t.left,
                      "right": [i + 1 for i in t.left], "cover": t.cover, "value": t.value})
    return trees, model.base[k]


def _stored_trees(model, class_index: int) -> list[dict] | None:
    """Trees of a Spark model, read from the table of nodes it saves; None if a cut is on more than two categories,
    which no threshold parts."""
    from pyspark.sql import SparkSession

    spark, classes = SparkSession.getActiveSession(), hasattr(model, "numClasses")
    path = scratch_path(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "treeID" in rows.columns:
        rows = rows.select("treeID", "nodeData.*")
    by_tree: dict = {}
    for r in rows.collect():                                   # one row per node of the model
        by_tree.setdefault(r["treeID"] if "treeID" in rows.columns else 0, []).append(r)
    trees = []
    for nodes in by_tree.values():
        nodes.sort(key=lambda r: r["id"])
        place = {r["id"]: i for i, r in enumerate(nodes)}
        tree: dict = {name: [] for name in ("feature", "threshold", "missing_left", "left", "right", "cover", "value")}
        for r in nodes:
            leaf, stats = r["leftChild"] < 0, r["impurityStats"]
            cut = None if leaf else r["split"]
            if cut is not None and cut["numCategories"] > 2:
                return None
            # of two categories, 0 and 1, one goes left
            flipped = cut is not None and cut["numCategories"] == 2 and list(cut["leftCategoriesOrThreshold"]) == [1.0]
            children = (-1, -1) if leaf else (place[r["leftChild"]], place[r["rightChild"]])
            tree["feature"].append(-1 if leaf else cut["featureIndex"])
            tree["threshold"].append(np.inf if leaf else 0.5 if cut["numCategories"] == 2 else cut["leftCategoriesOrThreshold"][0])
            tree["missing_left"].append(False)
            tree["left"].append(children[1] if flipped else children[0])
            tree["right"].append(children[0] if flipped else children[1])
            tree["cover"].append(sum(stats) if classes else stats[0])
            tree["value"].append(stats[class_index] / (sum(stats) or 1.0) if classes else r["prediction"])
        trees.append(tree)
    return [t | {"value": [v / len(trees) for v in t["value"]]} for t in trees]


def model_paths(model, class_index: int = 0) -> Paths | None:
    """Paths of a tree, a forest or a boosted model; None for any other. Classes: the probability of one class by
    trees and forests, the margin of boosted ones."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(last, Boosted):
        return paths_of(*_boosted_trees(last, class_index))
    if type(last).__name__ in ("DecisionTreeClassificationModel", "DecisionTreeRegressionModel", "RandomForestClassificationModel", "RandomForestRegressionModel"):
        trees = _stored_trees(last, class_index)
        return None if trees is None else paths_of(trees, 0.0)
    return None


def shapley_trees(prepared: DataFrame, key: list[str], paths: Paths, names: list[str]) -> DataFrame:
    """(key…, feature, contribution, base_value) of every row and feature, exact for the training shares of the paths.
    The paths of the model are what tasks share; rows do not move."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = prepared.select(*[col(k) for k in key], vector_to_array("features").alias("_x"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_c", T.ArrayType(T.DoubleType()))])
    shared = prepared.sparkSession.sparkContext.broadcast(paths)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        told = to_arrow_schema(schema)
        for batch in batches:
            lists = batch.column(len(key))
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(contributions(x, shared.value)), told.field(len(key)).type)], schema=told)
    cells = rows.mapInArrow(run, schema).select(*[col(k) for k in key], F.posexplode("_c").alias("_i", "contribution"))
    return cells.select(*[col(k) for k in key], F.try_element_at(F.lit(names), F.col("_i") + 1).alias("feature"), "contribution",
                        F.lit(paths.expected).alias("base_value"))
