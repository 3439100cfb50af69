"""Cluster quality.

``calinski_harabasz`` and ``silhouette_squared`` are linear: they need only per-cluster
sums. ``silhouette`` with plain Euclidean distance has no such closed form; it compares
blocks of distinct points with all distinct points, read from the shared folder, and emits one
row per point, never a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.functions.columns import col, present
from tabml.session import materialize, open_folder

BLOCK_ROWS = 4_000          # points per block of the exact silhouette
CHUNK_CELLS = 1_000_000     # doubles held at once while comparing two blocks
NEAR = 1e-4                 # squared distances below this share of the squared norms are taken from the differences


def as_array(df: DataFrame, features: str) -> Column:
    """The feature column (ML vector or numeric array) as array<double>."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return vector_to_array(col(features))
    return col(features).cast("array<double>")


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, n)."""
    return df.groupBy(col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def _moments(points: DataFrame) -> DataFrame:
    """Per cluster: size, mean vector, mean squared norm. Long form keeps the sums map-side."""
    long = points.select("cluster", F.posexplode("x").alias("d", "v"))
    sums = long.groupBy("cluster", "d").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"),
                                            F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("d", (F.col("s") / F.col("n")).alias("m"))))
    return sums.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(ordered, lambda s: s["m"]).alias("mean"),
                                       (F.sum("q") / F.max("n")).alias("norm2"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def calinski_harabasz(df: DataFrame, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """One row: between-cluster over within-cluster dispersion."""
    points = df.select(as_array(df, features).alias("x"), col(cluster).alias("cluster"))
    long = points.select("cluster", F.posexplode("x").alias("d", "v"))
    cells = long.groupBy("cluster", "d").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("spread"))
    by_d = cells.groupBy("d").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"),
                                  F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"),
                                  F.sum(F.col("spread") * F.col("n")).alias("within"))
    between = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    within = F.sum("within")
    k, n = F.max("k"), F.max("n")
    score = F.when(within > 0, between * (n - k) / (within * (k - 1))).otherwise(1.0)
    return by_d.agg(score.alias("calinski_harabasz_score"))


def silhouette_squared(df: DataFrame, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """Mean silhouette under squared Euclidean distance: linear in the rows.

    The mean squared distance from x to a cluster is |x|² - 2·x·mean + mean|y|². The cluster
    moments form one array with an entry per cluster, read by every row.
    """
    points = df.select(as_array(df, features).alias("x"), col(cluster).alias("cluster"))
    table = _moments(points).agg(F.collect_list(F.struct("cluster", "n", "mean", "norm2"))).scalar()
    own = points.withColumn("x2", _dot(F.col("x"), F.col("x"))).withColumn("t", table)
    far = F.transform("t", lambda c: F.struct(
        c["cluster"].alias("cluster"), c["n"].alias("n"),
        F.greatest(F.lit(0.0), F.col("x2") - 2 * _dot(F.col("x"), c["mean"]) + c["norm2"]).alias("d")))
    measured = own.select("cluster", far.alias("far"))
    same = F.filter("far", lambda c: c["cluster"] == F.col("cluster"))[0]
    rest = F.array_min(F.transform(F.filter("far", lambda c: c["cluster"] != F.col("cluster")), lambda c: c["d"]))
    scored = measured.select(same["n"].alias("n"), (same["d"] * same["n"] / F.greatest(same["n"] - 1, F.lit(1))).alias("a"), rest.alias("b"))
    return scored.agg(F.avg(_silhouette(F.col("n"), F.col("a"), F.col("b"))).alias("silhouette_squared"))


def _silhouette(n: Column, a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when((n == 1) | (top == 0), 0.0).otherwise((b - a) / top)


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean silhouette under Euclidean distance, exact (quadratic work, in blocks).

    Equal points of a cluster are counted once with a weight, so copies cost nothing.
    """
    single = df.schema[features].dataType == T.ArrayType(T.FloatType())       # half as wide until they are compared
    x, name = col(features) if single else as_array(df, features), present(df, cluster).cast("string")
    points = df.groupBy(x.alias("x"), name.alias("cluster")).agg(F.count(F.lit(1)).alias("w"))
    points = materialize(points.orderBy("cluster", F.xxhash64("x")), "silhouette")
    n = points.count()
    blocks = max(1, -(-n // block_rows))
    numbers = df.sparkSession.range(0, blocks, 1, blocks)
    each = numbers.mapInArrow(_against(points.scratch, n, block_rows), "w bigint, n bigint, a double, b double")
    value = _silhouette(F.col("n"), F.col("a"), F.col("b"))
    return each.agg((F.sum(value * F.col("w")) / F.sum("w")).alias("silhouette_score"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows of a, rows of b) from products; near points, where these cancel, by their differences."""
    sizes = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
    squared = sizes - 2 * (a @ b.T)
    i, j = np.nonzero(~(squared > NEAR * sizes))
    step = max(1, CHUNK_CELLS // a.shape[1])
    for start in range(0, len(i), step):
        part = slice(start, start + step)
        squared[i[part], j[part]] = ((a[i[part]] - b[j[part]]) ** 2).sum(axis=1)
    return np.sqrt(squared)


def _rows(folder: str, start: int, stop: int, step: int) -> Iterator:
    """(points, names, weights), up to ``step`` at once, of the rows from ``start`` to before ``stop`` of a folder's files in their order."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, path = open_folder(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
    for name in sorted(files, key=lambda f: (len(f), f)):
        with store.open_input_file(name) as source:
            file, at = pq.ParquetFile(source), 0
            rows = file.metadata.num_rows
            for batch in file.iter_batches(step, columns=["x", "cluster", "w"]) if start < rows and stop > 0 else ():
                low, high = max(start - at, 0), min(stop - at, batch.num_rows)
                if low < high:
                    x, names, weights = (c.to_numpy(zero_copy_only=False) for c in batch.slice(low, high - low).columns)
                    yield np.stack(x).astype(float), names, weights
                at += batch.num_rows
        start, stop = start - rows, stop - rows


def _against(folder: str, n: int, block_rows: int):
    """(w, n, a, b) of the points of numbered blocks: weight, size of their cluster, mean distance in it and to the nearest other
    one. The ``n`` points of ``folder``, ordered by cluster, are read through for every block and never dealt out."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for block in (k for batch in batches for k in batch.column(0).to_pylist()):
            own = list(_rows(folder, block * block_rows, min(n, (block + 1) * block_rows), block_rows))
            if not own:
                continue
            x, names, weights = (np.concatenate(c) for c in zip(*own))
            size, a, b, lone = _block_sums(x, names, _rows(folder, 0, n, max(1, CHUNK_CELLS // len(x))))
            columns = [pa.array(weights), pa.array(size, mask=size == 0), pa.array(a, mask=size == 0), pa.array(b, mask=lone)]
            yield pa.RecordBatch.from_arrays(columns, ["w", "n", "a", "b"])
    return run


def _block_sums(here: np.ndarray, own: np.ndarray, chunks: Iterator) -> tuple:
    """Of points and their clusters' names: size of the cluster, mean distance in it, least mean distance to another, and
    whether there is no other. ``chunks`` (points, names, weights) are ordered by name, so that one cluster is open at a time."""
    n, a, b, lone = np.zeros(len(here), np.int64), np.zeros(len(here)), np.full(len(here), np.nan), np.ones(len(here), bool)

    def close(names, totals, sizes):
        mine = own[:, None] == names
        row, at = np.nonzero(mine)
        n[row], a[row] = sizes[at], totals[row, at] / np.maximum(sizes[at] - 1, 1)
        if len(names):
            b[:] = np.fmin(b, np.fmin.reduce(np.where(mine, np.nan, totals / sizes), axis=1))
            lone[:] &= mine.all(axis=1)

    names, totals, sizes = np.empty(0, object), np.zeros((len(here), 0)), np.zeros(0, np.int64)
    for there, clusters, weights in chunks:
        known = np.array([c is not None for c in clusters])                  # points of no cluster count in none
        there, clusters, weights = there[known], clusters[known], weights[known]
        if not len(there):
            continue
        middle = there.mean(axis=0)                                      # products lose the less the smaller the numbers are
        starts = np.flatnonzero(np.append(True, clusters[1:] != clusters[:-1]))
        found = np.add.reduceat(_distances(here - middle, there - middle) * weights, starts, axis=1)
        more = np.add.reduceat(weights, starts)
        if len(names) and names[0] == clusters[0]:
            found[:, 0] += totals[:, 0]
            more[0] += sizes[0]
        else:
            close(names, totals, sizes)
        close(clusters[starts[:-1]], found[:, :-1], more[:-1])
        names, totals, sizes = clusters[starts[-1:]], found[:, -1:], more[-1:]
    close(names, totals, sizes)
    return n, a, b, lone


def evaluate_clusters(df: DataFrame, features: str = "features", cluster: str = "cluster",
                      silhouette_form: str = "silhouette_score") -> DataFrame:
    """(n_clusters, calinski_harabasz_score, and the chosen silhouette under its own name).

    ``silhouette_form`` is silhouette_score (Euclidean, quadratic work) or silhouette_squared (linear
    work); the choice is the caller's at every size.
    """
    known = df.filter(col(cluster).isNotNull())
    forms = {"silhouette_score": silhouette, "silhouette_squared": silhouette_squared}
    return (known.agg(F.count_distinct(col(cluster)).alias("n_clusters"))
            .withColumn("calinski_harabasz_score", calinski_harabasz(known, features, cluster).scalar())
            .withColumn(silhouette_form, forms[silhouette_form](known, features, cluster).scalar()))
