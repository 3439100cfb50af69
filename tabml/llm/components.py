"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.llm.common import spread_join
from tabml.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return spread_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = spread_join(edges, least, ["a"]).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least).toDF("a", "b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a > b, longs): root is the smallest node reachable.

    Two star steps a round end in one star per component after few rounds (logarithmically many
    in practice, whatever the diameter). Each round is written to the shared folder, so lineage
    stays short and a lost executor repeats one round at most. A hot centre is pre-aggregated
    before its exchange and its join is left splittable.
    """
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(_large_star(edges)), "components")
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root")).distinct()
