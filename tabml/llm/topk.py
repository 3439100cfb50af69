"""Exact top-k inner products from an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabml.session import materialize

#: vectors per block of the index, query vectors per block of queries
BLOCK, QUERIES = 4096, 1024
#: products beyond this are added up as Python's unbounded integers
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def quantised(df: DataFrame, id: str, vector: str, scale: int = 64) -> DataFrame:
    """(id, v): components floor(scale * x) as longs, x read as double. Rows whose vector is NULL
    or holds NULL, NaN or infinities are left out; values beyond a long stop at its ends."""
    x = F.col(vector).cast("array<double>")
    good = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform(x, lambda e: F.when(F.abs(e * scale) < 9.2e18, F.floor(e * scale).cast("long"))
                        .otherwise(F.when(e > 0, F.lit(LONG)).otherwise(F.lit(-LONG))))
    return df.where(good).select(F.col(id).cast("long").alias("id"), whole.alias("v"))


def _levels(v):
    """Quantised impact of each value: the bits of its magnitude."""
    import numpy as np
    return np.where(v == 0, 0, np.frexp(np.abs(v).astype(np.float64))[1])


def _segments(block: int):
    def run(batches: Iterator) -> Iterator:
        """Blocks are cut from a partition as it comes, so no row moves to build the index."""
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        first, count, held = TaskContext.get().partitionId() << 32, 0, []

        def index(rows):
            at = first + count
            ids, vectors = [r[0] for r in rows], [r[1] for r in rows]
            width = max(map(len, vectors), default=0)
            v = np.zeros((len(rows), width), np.int64)
            for i, x in enumerate(vectors):
                v[i, :len(x)] = x
            levels = _levels(v)
            places = np.array([-1 if x is None else x for x in ids], np.int64)
            known = np.array([x is not None for x in ids])
            out = [(at, -1, width, places.tobytes(), known.tobytes(), b"")]
            for level in sorted(set(np.unique(levels)) - {0}, reverse=True):
                row, dim = np.nonzero(levels == level)
                out.append((at, int(level), width, row.astype(np.int32).tobytes(), dim.astype(np.int32).tobytes(), v[row, dim].tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["block", "level", "width", "rows", "dims", "impacts"])

        for batch in batches:
            for id, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((id, v.values.to_numpy(zero_copy_only=False)))
                if len(held) == block:
                    yield index(held)
                    held, count = [], count + 1
        if held:
            yield index(held)
    return run


def build_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Posting segments of (id, v): for each block of rows and each impact level, highest first,
    the rows, dimensions and signed impacts of that level. Level -1 holds the block's ids."""
    schema = "block long, level int, width int, rows binary, dims binary, impacts binary"
    return materialize(vectors.mapInArrow(_segments(block), schema), "impact-index")


def _best(q, ids, known, width, segments, own, k):
    """The k best rows of a block for each query of a block: (query, row, exact score).

    Segments are added to all scores in descending impact. After each, what a row still misses is
    at most the norm of the query times the norm of the row's open entries. A row stays possible
    while its best case reaches the k-th best worst case; when no query has more possible rows than
    it needs, or no segment is left, the possible rows are scored exactly.
    """
    import numpy as np

    n, dims = len(ids), max(q.shape[1], width)
    big = max((int(np.abs(s[2]).max()) for s in segments), default=0)
    largest = float(np.abs(q).max(initial=0)) * big * max(dims, 1)
    v = np.zeros((n, dims), np.int64)
    open_square = np.zeros(n)
    for rows, cols, impacts in segments:
        v[rows, cols] = impacts
        np.add.at(open_square, rows, impacts.astype(np.float64) ** 2)
    qf = np.zeros((len(q), dims))
    qf[:, :q.shape[1]] = q
    norms = np.sqrt((qf ** 2).sum(axis=1)) * (1 + 1e-9)
    scores = np.zeros((len(q), n))
    allowed = ~(own[:, None] == ids[None, :]) | ~known[None, :]
    wanted = np.minimum(k, allowed.sum(axis=1))
    possible = allowed
    for i, (rows, cols, impacts) in enumerate(segments):
        level = np.zeros((n, dims))
        level[rows, cols] = impacts
        scores += qf @ level.T
        np.subtract.at(open_square, rows, impacts.astype(np.float64) ** 2)
        if i + 1 < len(segments):
            miss = np.sqrt(np.maximum(open_square, 0)) * (1 + 1e-9)
            slack = norms[:, None] * miss[None, :] + 1e-6 * (1 + largest)
            worst = np.where(allowed, scores - slack, -np.inf)
            bar = -np.partition(-worst, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
            possible = allowed & (scores + slack >= bar[:, None])
            if (possible.sum(axis=1) <= wanted).all():      # proof: no other row can come in
                break
        else:
            possible = allowed
            if largest < EXACT:
                bar = -np.partition(-np.where(allowed, scores, -np.inf), min(k, n) - 1, axis=1)[:, min(k, n) - 1]
                possible = allowed & (scores >= bar[:, None])
    out = []
    order_ids = np.where(known, ids, LONG)
    for j in range(len(q)):
        rows = np.flatnonzero(possible[j])
        if largest < EXACT:
            exact = v[rows, :q.shape[1]] @ q[j][:dims]
            keep = np.lexsort((order_ids[rows], -exact))[:k]
            out += [(j, rows[x], int(exact[x])) for x in keep]
        else:
            sums = [max(-LONG, min(LONG, sum(int(a) * int(b) for a, b in zip(v[r], q[j])))) for r in rows]
            keep = sorted(range(len(rows)), key=lambda x: (-sums[x], order_ids[rows[x]]))[:k]
            out += [(j, rows[x], sums[x]) for x in keep]
    return out


def _search(k: int):
    def run(left, right):
        import numpy as np
        import pandas as pd

        out = []
        if len(left) and len(right):
            width = max(map(len, right["v"]))
            q = np.zeros((len(right), width), np.int64)
            for i, x in enumerate(right["v"]):
                q[i, :len(x)] = x
            own, serial = right["id"].to_numpy(np.int64), right["query"].to_numpy(np.int64)
            for _, own_block in left.groupby("block"):
                head = own_block[own_block["level"] == -1].iloc[0]
                ids, known = np.frombuffer(head["rows"], np.int64), np.frombuffer(head["dims"], bool)
                parts = own_block[own_block["level"] >= 0].sort_values("level", ascending=False)
                segments = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), np.frombuffer(c, np.int64))
                            for a, b, c in zip(parts["rows"], parts["dims"], parts["impacts"])]
                for j, row, score in _best(q, ids, known, int(head["width"]), segments, own, k):
                    out.append((serial[j], own[j], ids[row] if known[row] else None, score))
        columns = zip(*out) if out else [()] * 4
        return pd.DataFrame({n: pd.array(list(c), "Int64") for n, c in zip(("query", "query_id", "id", "score"), columns)})
    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of the index for every query (id, v), the rows
    with the query's own id left out; ties go to the smaller id, NULL last.

    Query blocks meet every index block by an equi-join on block numbers; each meeting yields at
    most k rows per query, and the best k of those are the result.
    """
    asked = materialize(queries.where("id is not null").distinct().withColumn("query", F.xxhash64("id", "v")), "queries")
    blocks = max(1, -(-asked.count() // block))
    groups = max(1, index.where("level = -1").count())
    asked = asked.withColumns({"part": F.pmod("query", F.lit(blocks)), "group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    spread = index.withColumns({"group": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"),
                                "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    met = spread.groupBy("group", "part").cogroup(asked.groupBy("group", "part")).applyInPandas(
        _search(k), "query long, query_id long, id long, score long")
    best = Window.partitionBy("query", "query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def exact_top_k(df: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score) of the k highest integer inner products of quantised vectors.

    ``df`` and ``queries`` have the columns ``id`` and ``vector``. Vectors that are NULL or hold
    NULL or non-finite components take no part; components missing in a shorter vector count as
    zero. Rows with a NULL id are candidates but no queries. Repeated rows are candidates each;
    a query repeated with its vector is asked once. Fewer than k candidates: all of them. No rows:
    no rows. Sums beyond a long stop at its ends. Other columns are not looked at.
    """
    return search(build_index(quantised(df, id, vector, scale)), quantised(queries, id, vector, scale), k)
