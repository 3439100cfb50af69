"""Exact k nearest neighbours without comparing every row with every row.

Training rows are grouped to distinct (point, label) with a weight, then assigned to the
nearest of a few pivots. Per cell only its weight and radius are kept on the driver. For a
query the triangle inequality gives a bound that k neighbours surely satisfy, and only cells
that may reach inside the bound are searched (Lu et al. 2012, "Efficient processing of k
nearest neighbor joins using MapReduce"). Pivots are grouped in the same way, so that a row is
measured against the pivots of near groups only. Cells are searched in bounded blocks of training
points and queries, so a cell holding a third of all rows is many tasks. Equal distances are
settled by the smaller label, so the answer does not depend on the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabml.functions.columns import col
from tabml.operators.cluster_metrics import as_array
from tabml.session import materialize

FEW_PIVOTS = 1_024          # beyond this many, pivots grow with the square root of the points
CELL_ROWS = 500             # aimed-at training points per cell while there are few
BLOCK_ROWS = 4_000          # training points or queries per searched block
CHUNK_CELLS = 4_000_000     # doubles held at once while comparing
ROUNDING = 1e-10            # relative error allowed to the matrix product before exact measuring
SLACK = 1e-9                # relative room for rounding when cells are ruled out


def point(df: DataFrame, features: str) -> Column:
    """The feature values as an array; adding zero makes -0.0 and 0.0 the same point."""
    return F.transform(as_array(df, features), lambda v: v + 0.0)


def point_id(x: Column | str) -> dict[str, Column]:
    """128 bits that stand for a point where the point itself would be carried through a shuffle."""
    return {"q1": F.xxhash64(x), "q2": F.xxhash64(F.lit("second"), x)}


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, CHUNK_CELLS // max(1, len(b) * b.shape[1]))
    for s in range(0, len(a), step):
        gap = a[s:s + step, None, :] - b[None, :, :]
        out[s:s + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def _nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b, ties to the earlier row of b.

    A matrix product sorts out far rows; everything within its rounding error of the k-th
    distance is measured again exactly, so the result does not depend on the shortcut.
    """
    size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    found = []
    step = max(1, CHUNK_CELLS // len(b))
    for s in range(0, len(a), step):
        part = a[s:s + step]
        rough = size_a[s:s + step, None] + size_b[None, :] - 2 * (part @ b.T)
        near = np.full(len(part), np.inf)
        if len(b) > k:
            near = np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = ROUNDING * (size_a[s:s + step] + size_b.max())
        rows, columns = np.nonzero(rough <= (near + slack)[:, None])
        distance = np.empty(len(rows))
        piece = max(1, CHUNK_CELLS // a.shape[1])
        for i in range(0, len(rows), piece):
            gap = part[rows[i:i + piece]] - b[columns[i:i + piece]]
            distance[i:i + piece] = np.sqrt((gap * gap).sum(axis=1))
        order = np.lexsort((columns, distance, rows))
        rows, columns, distance = rows[order], columns[order], distance[order]
        first = np.searchsorted(rows, np.arange(len(part)))
        keep = np.arange(len(rows)) - first[rows] < k
        found.append((rows[keep] + s, columns[keep], distance[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _groups(centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """(centres of groups, their cells, how far the cells reach): the square root of the cells are groups."""
    tops = centres[:math.isqrt(len(centres) - 1) + 1]
    step = max(1, CHUNK_CELLS // (len(tops) * centres.shape[1]))
    found = [_distances(centres[i:i + step], tops) for i in range(0, len(centres), step)]
    own, gap = np.concatenate([d.argmin(axis=1) for d in found]), np.concatenate([d.min(axis=1) for d in found])
    named = np.unique(own)
    cells = [np.flatnonzero(own == g) for g in named]
    return tops[named], cells, np.array([(gap[c] + radii[c]).max() for c in cells])


def _bound(far: np.ndarray, weights: np.ndarray, enough: int) -> np.ndarray:
    """Per row the distance within which the nearest cells surely hold ``enough`` rows; infinite where all are fewer."""
    bound = np.full(len(far), np.inf)
    few, open_rows = min(far.shape[1], 2 * enough + 8), np.arange(len(far))
    while len(open_rows):           # the nearest few cells nearly always do
        part = far[open_rows]
        order = np.argpartition(part, few - 1, axis=1)[:, :few] if few < far.shape[1] else np.argsort(part, axis=1)
        near = np.take_along_axis(part, order, axis=1)
        sort = np.argsort(near, axis=1)
        order, near = np.take_along_axis(order, sort, axis=1), np.take_along_axis(near, sort, axis=1)
        filled = np.cumsum(weights[order], axis=1) >= enough
        done = filled[:, -1]
        bound[open_rows[done]] = near[done, filled[done].argmax(axis=1)]
        if few == far.shape[1]:
            break
        open_rows, few = open_rows[~done], min(far.shape[1], 16 * few)
    return bound


def _within(d: np.ndarray, bound: np.ndarray) -> np.ndarray:
    return d <= (bound * (1 + SLACK) + SLACK)[:, None]


def _near_cells(x: np.ndarray, centres: np.ndarray, radii: np.ndarray, weights: np.ndarray, enough: int, groups):
    """(rows, cells, distances, may reach inside the bound), for some rows at a time. Rows of the nearest group go
    together: its cells give a first bound, and only groups that may reach inside that are measured."""
    tops, members, reach = groups
    step = max(1, CHUNK_CELLS // (2 * len(centres)))
    for start in range(0, len(x), step):
        part = x[start:start + step]
        to_top = _distances(part, tops)
        own = to_top.argmin(axis=1)
        for g in np.unique(own):
            rows = np.flatnonzero(own == g)
            mine = members[g]
            first = _bound(_distances(part[rows], centres[mine]) + radii[mine], weights[mine], enough)
            some = _within(to_top[rows] - reach, first).any(axis=0)
            cells = np.sort(np.concatenate([members[i] for i in np.flatnonzero(some)]))
            d = _distances(part[rows], centres[cells])
            yield rows + start, cells, d, _within(d - radii[cells], _bound(d + radii[cells], weights[cells], enough))


def neighbours(train: DataFrame, queries: DataFrame, k: int = 5, features: str = "features", label: str = "label",
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(q1, q2, label, distance, votes): the k nearest training rows of every distinct query point.

    q1, q2 are the ``point_id`` of the query point. A training point that occurs several times
    has several votes; the votes of a query sum to k.
    """
    spark = train.sparkSession
    label_type = train.schema[label].dataType.simpleString()
    points = train.filter(col(label).isNotNull()).groupBy(point(train, features).alias("x"), col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("w"))
    asked = queries.select(point(queries, features).alias("x")).distinct()

    points = materialize(points, "knn-points")          # read for pivots, cell sizes and the search
    n = points.count()
    if n == 0:
        raise ValueError("No training rows with a label")
    n_pivots = int(max(min(FEW_PIVOTS, n // CELL_ROWS + 1), math.isqrt(n) if n > FEW_PIVOTS ** 2 else 1))
    rows = points.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(n_pivots).collect()
    pivots = np.array([r["x"] for r in rows])

    none, one = np.zeros(len(pivots)), np.ones(len(pivots))
    pivot_groups = _groups(pivots, none)

    @F.pandas_udf("struct<cell: int, radius: double>")
    def nearest_pivot(x: pd.Series) -> pd.DataFrame:
        cell, radius = np.zeros(len(x), "int32"), np.zeros(len(x))
        if len(x):
            for rows, near, d, _ in _near_cells(np.stack(x.to_numpy()), pivots, none, one, 1, pivot_groups):
                cell[rows], radius[rows] = near[d.argmin(axis=1)], d.min(axis=1)
        return pd.DataFrame({"cell": cell, "radius": radius})

    celled = points.select("*", nearest_pivot("x").alias("c")).select("x", "label", "w", "c.cell", "c.radius")
    stats = {r["cell"]: r for r in celled.groupBy("cell").agg(
        F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")).collect()}
    cells = np.array(sorted(stats))
    centres = pivots[cells]
    weights = np.array([stats[c]["w"] for c in cells])
    radii = np.array([stats[c]["radius"] for c in cells])
    enough = min(k, int(weights.sum()))
    cell_groups = _groups(centres, radii)

    @F.pandas_udf("array<int>")
    def reachable_cells(x: pd.Series) -> pd.Series:
        out = np.empty(len(x), object)
        if len(x):
            for rows, near, _, keep in _near_cells(np.stack(x.to_numpy()), centres, radii, weights, enough, cell_groups):
                for row, own in zip(rows, keep):
                    out[row] = cells[near[own]].tolist()
        return pd.Series(out)

    searched = materialize(asked.select("x", F.explode(reachable_cells("x")).alias("cell")), "knn-searched")
    loads = {r["cell"]: r["n"] for r in searched.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(
        [(int(c), max(1, -(-stats[c]["n"] // block_rows)), max(1, -(-loads.get(c, 0) // block_rows))) for c in cells],
        "cell int, t_blocks long, q_blocks long")        # a row per pivot

    def numbers(count):
        return F.sequence(F.lit(0), F.col(count) - 1).cast("array<bigint>")

    left = (searched.withColumns(point_id("x")).join(F.broadcast(plan), "cell").withColumn("q", F.pmod("q1", F.col("q_blocks")))
            .select("q1", "q2", "x", "cell", "q", F.explode(numbers("t_blocks")).alias("t")))
    right = (celled.join(F.broadcast(plan), "cell").withColumn("t", F.pmod(F.xxhash64("x", "label"), F.col("t_blocks")))
             .select("x", "label", "w", "cell", "t", F.explode(numbers("q_blocks")).alias("q")))

    def search(asked_block: pd.DataFrame, train_block: pd.DataFrame) -> pd.DataFrame:
        if asked_block.empty or train_block.empty:
            return pd.DataFrame({"q1": [], "q2": [], "label": [], "distance": [], "w": []})
        ordered = train_block.sort_values("label", kind="stable")
        b, labels, w = np.stack(ordered["x"].to_numpy()), ordered["label"].to_numpy(), ordered["w"].to_numpy()
        asked_rows, train_rows, distance = _nearest(np.stack(asked_block["x"].to_numpy()), b, k)
        return pd.DataFrame({"q1": asked_block["q1"].to_numpy()[asked_rows], "q2": asked_block["q2"].to_numpy()[asked_rows],
                             "label": labels[train_rows], "distance": distance, "w": w[train_rows]})

    found = left.groupBy("cell", "t", "q").cogroup(right.groupBy("cell", "t", "q")).applyInPandas(
        search, f"q1 bigint, q2 bigint, label {label_type}, distance double, w bigint")
    ranked = Window.partitionBy("q1", "q2").orderBy("distance", "label")
    nearest = found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k)
    before = F.coalesce(F.sum("w").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return nearest.withColumn("before", before).filter(F.col("before") < k).select(
        "q1", "q2", "label", "distance", F.least(F.col("w"), k - F.col("before")).alias("votes"))


def knn_classify(train: DataFrame, queries: DataFrame, k: int = 5, features: str = "features", label: str = "label") -> DataFrame:
    """Adds ``prediction``: the majority label of the k nearest training rows, ties to the smallest label."""
    votes = neighbours(train, queries, k, features, label).groupBy("q1", "q2", "label").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("q1", "q2").agg(F.min_by("label", F.struct((-F.col("votes")).alias("v"), "label")).alias("prediction"))
    return _attach(queries, best, features)


def knn_regress(train: DataFrame, queries: DataFrame, k: int = 5, features: str = "features", label: str = "label") -> DataFrame:
    """Adds ``prediction``: the mean label of the k nearest training rows."""
    means = neighbours(train, queries, k, features, label).groupBy("q1", "q2").agg(
        (F.sum(F.col("label") * F.col("votes")) / F.sum("votes")).alias("prediction"))
    return _attach(queries, means, features)


def _attach(queries: DataFrame, predicted: DataFrame, features: str) -> DataFrame:
    keyed = queries.withColumns(point_id(point(queries, features)))
    return keyed.join(predicted, ["q1", "q2"], "left").drop("q1", "q2")
