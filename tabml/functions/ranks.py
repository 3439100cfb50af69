"""Order statistics that never sort the whole table in one task.

* ``exact_quantiles``: exact linear-interpolated quantiles. Small inputs take one
  ``percentile`` pass. Large ones bracket each wanted rank with ``percentile_approx``
  (a bounded sketch), count what lies below, and look at single values only inside a
  bracket of at most ``BRACKET_ROWS`` rows.
* ``hash_cutoffs``: the k-th smallest row hash, from counts per hash prefix, so that a
  random split is a comparison with literals and the wide rows are never shuffled.
* ``running_totals``: cumulative sums over a global order, in value buckets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabml.functions.columns import col, present

ONE_PASS_ROWS = 2_000_000   # up to here one `percentile` aggregate holds all distinct values
BRACKET_ROWS = 100_000      # rows looked at one by one around a wanted rank
SKETCH_ACCURACY = 10_000    # percentile_approx: rank error at most n / accuracy
BUCKET_ROWS = 1_000_000     # rows that one task of a running total orders
MAX_BUCKETS = 5_000         # bucket totals that one task accumulates
PREFIX_LENGTH = 4           # hex digits: at most 65 536 prefix counts


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                    one_pass_rows: int = ONE_PASS_ROWS, at_most: int | None = None) -> dict[str, list[float | None]]:
    """{column: [quantile per probability]}, linear interpolation, missing values ignored.

    ``at_most`` is a known upper bound of the row count, which saves counting.
    """
    if not columns:
        return {}
    values = df.select([present(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = values.columns
    if (df.count() if at_most is None else at_most) <= one_pass_rows:
        grid = F.array([F.lit(float(p)) for p in probabilities])
        row = values.agg(*[F.percentile(n, grid).alias(n) for n in names]).first()
        return {c: list(row[n]) if row[n] is not None else [None] * len(probabilities)
                for c, n in zip(columns, names)}

    near = F.array([F.lit(x) for p in probabilities for x in _around(p)])
    row = values.agg(*[e for n in names for e in (
        F.count(n).alias(n), F.min(n).alias(f"{n}_lo"), F.max(n).alias(f"{n}_hi"),
        F.percentile_approx(n, near, SKETCH_ACCURACY).alias(f"{n}_near"))]).first()
    wanted: dict[tuple[str, int], tuple[float, float]] = {}      # rank: the values around it by the sketch
    for n in names:
        for i, p in enumerate(probabilities):
            if row[n]:
                at = p * (row[n] - 1)
                wanted[(n, math.floor(at))] = wanted[(n, math.ceil(at))] = tuple(row[f"{n}_near"][2 * i:2 * i + 2])
    found = _values_at_ranks(values, {n: (row[f"{n}_lo"], row[f"{n}_hi"], 0, row[n]) for n in names}, wanted)
    out = {}
    for c, n in zip(columns, names):
        out[c] = []
        for p in probabilities:
            if not row[n]:
                out[c].append(None)
                continue
            at = p * (row[n] - 1)
            low, high = found[(n, math.floor(at))], found[(n, math.ceil(at))]
            out[c].append(low + (high - low) * (at - math.floor(at)))
    return out


def _around(share: float) -> tuple[float, float]:
    """Two shares between which the sketched value of a share lies for sure, or nearly so."""
    margin = 2.0 / SKETCH_ACCURACY
    return max(0.0, share - margin), min(1.0, share + margin)


def _values_at_ranks(values: DataFrame, whole: dict[str, tuple], targets: dict[tuple[str, int], tuple[float, float]]) -> dict:
    """Exact order statistics (0-based ranks) by narrowing value brackets. ``whole`` is the bracket of all
    values of a column, ``targets`` the values between which a rank is looked for first."""
    # bracket: lowest value, highest value, rows below it, rows inside it
    bracket = {t: whole[t[0]] for t in targets}
    narrowed = targets
    stuck: set = set()
    while True:
        wide = [t for t, (a, b, _, inside) in bracket.items() if a < b and inside > BRACKET_ROWS and t not in stuck]
        if not wide:
            break
        if narrowed is None:
            narrowed = _sketched(values, {t: bracket[t] for t in wide})
        counts = []
        for i, t in enumerate(wide):
            lo, hi = narrowed[t]
            counts.append(F.count_if(col(t[0]) < lo).alias(f"b{i}"))
            counts.append(F.count_if(col(t[0]).between(lo, hi)).alias(f"n{i}"))
        counted = values.agg(*counts).first()
        for i, t in enumerate(wide):
            a, b, below, inside = bracket[t]
            lo, hi = narrowed[t]
            n_below, n_inside = counted[f"b{i}"], counted[f"n{i}"]
            if not n_below <= t[1] < n_below + n_inside or n_inside >= inside:
                stuck.add(t)            # keep the last good bracket, finish from value counts
            else:
                bracket[t] = (lo, hi, n_below, n_inside)
        narrowed = None
    found = {t: a for t, (a, b, _, _) in bracket.items() if a == b}
    rest = [t for t in targets if t not in found]
    if rest:
        picks, near = [], F.lit(False)
        for i, t in enumerate(rest):
            a, b, below, _ = bracket[t]
            near = near | col(t[0]).between(a, b)
            picks.append(F.when(col(t[0]).between(a, b),
                                F.struct(F.lit(i).alias("i"), F.lit(t[1] - below).alias("k"), col(t[0]).alias("v"))))
        each = values.filter(near).select(F.explode(F.filter(F.array(*picks), lambda s: s.isNotNull())).alias("s")).select("s.*")
        counted = each.groupBy("i", "k", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
        rows = (counted.withColumn("upto", upto)
                .filter((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
                .select("i", "v").collect())
        found.update({rest[r["i"]]: r["v"] for r in rows})
    return found


def _sketched(values: DataFrame, brackets: dict) -> dict:
    """{(column, rank): two values around it}, from one sketch per bracket."""
    shared: dict = {}                    # one sketch serves all ranks inside a bracket
    for t, place in brackets.items():
        shared.setdefault((t[0], *place), []).append(t)
    sketches, ends = [], {}
    for i, ((name, a, b, below, inside), inner) in enumerate(shared.items()):
        grid = []
        for t in inner:
            ends[t] = (f"s{i}", len(grid))
            grid += _around((t[1] - below + 0.5) / inside)
        values_in = F.when(col(name).between(a, b), col(name))
        sketches.append(F.percentile_approx(values_in, grid, SKETCH_ACCURACY).alias(f"s{i}"))
    row = values.agg(*sketches).first()
    return {t: tuple(row[s][k:k + 2]) for t, (s, k) in ends.items()}


def row_hash(keys: list[str], seed: int | str) -> Column:
    """Hex md5 over the key columns and a seed: the pseudo-random order of all splits."""
    return F.md5(F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_cutoffs(hashes: DataFrame, name: str, ranks: list[int]) -> list[str]:
    """The hash values at the given 1-based ranks of the ascending order."""
    prefix = F.substring(col(name), 1, PREFIX_LENGTH)
    counts = (hashes.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).toPandas()
              .sort_values("p").reset_index(drop=True))
    upto = np.cumsum(counts["n"].to_numpy())
    wanted = {}
    for r in ranks:
        i = int(np.searchsorted(upto, r))
        wanted[r] = (counts["p"][i], int(r - (upto[i] - counts["n"][i])))
    inside = hashes.select(prefix.alias("p"), col(name).alias("h")).filter(
        F.col("p").isin(sorted({p for p, _ in wanted.values()})))
    place = F.row_number().over(Window.partitionBy("p").orderBy("h"))
    rows = (inside.withColumn("k", place)
            .filter(F.col("k").isin(sorted({k for _, k in wanted.values()}))).collect())
    at = {(r["p"], r["k"]): r["h"] for r in rows}
    return [at[wanted[r]] for r in ranks]


def group_hash_cutoffs(hashes: DataFrame, name: str, group: str, take: DataFrame) -> DataFrame:
    """Per group the hash at rank ``take.k`` (``take``: group, k). Returns (group, cutoff)."""
    prefixed = hashes.select(col(group), F.substring(col(name), 1, PREFIX_LENGTH).alias("p"), col(name).alias("h"))
    counts = prefixed.groupBy(group, "p").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy("p"))
    holder = (counts.withColumn("upto", upto).join(take.filter("k > 0"), group)
              .filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
              .select(group, "p", (F.col("k") - (F.col("upto") - F.col("n"))).alias("k")))
    place = F.row_number().over(Window.partitionBy(group, "p").orderBy("h"))
    return (prefixed.join(holder, [group, "p"]).withColumn("place", place)
            .filter("place = k").select(group, F.col("h").alias("cutoff")))


def running_totals(df: DataFrame, order: str, sums: list[str], by: list[str] = (), spread: DataFrame | None = None,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``<s>_before``: the sum of ``s`` over rows of the same ``by`` with a smaller ``order``.

    ``df`` must hold one row per (by, order). Rows are bucketed by sketched quantiles of
    ``order`` over ``spread`` (default ``df``; the rows before grouping save a second
    shuffle), so a bucket holds about ``bucket_rows`` rows besides copies, which are one row
    here. Only bucket totals, at most MAX_BUCKETS per group, are accumulated in one place.
    """
    by = list(by)
    spread = df if spread is None else spread
    buckets = min(MAX_BUCKETS, -(-spread.count() // bucket_rows))
    edges = []
    if buckets > 1:
        grid = [i / buckets for i in range(1, buckets)]
        edges = spread.agg(F.percentile_approx(col(order).cast("double"), grid, SKETCH_ACCURACY)).first()[0] or []
    splits = [float("-inf"), *(sorted(set(edges)) or [0.0]), float("inf")]      # two buckets at least
    bucketed = Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket").transform(
        df.withColumn("_order", col(order).cast("double")))
    keys = [*by, "_bucket"]
    totals = bucketed.groupBy(*keys).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums])
    within = Window.partitionBy(*keys).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    out = bucketed.join(offsets, keys)
    for s in sums:
        out = out.withColumn(f"{s}_before", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(within), F.lit(0)))
    return out.drop("_order", "_bucket", *[f"_o_{s}" for s in sums])
