"""Train/test splits and folds, decided by comparing a row hash with a few cutoffs.

The wide rows are never sorted or shuffled (beyond FEW_CLASSES classes the stratified split joins
them with the cutoffs). ``key`` must identify a row; copies of a key
share a hash and so stay on the same side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.functions.columns import col
from tabml.functions.ranks import group_hash_cutoffs, hash_cutoffs, row_hash

SEED = 42
FEW_CLASSES = 1_000     # so many cutoffs go into the plan


def split_random(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds ``split``: the ceil(test_size·n) rows with the smallest hash are the test rows."""
    h = row_hash(key, seed)
    n_test = math.ceil(test_size * df.count())
    if n_test == 0:
        return df.withColumn("split", F.lit("train"))
    cutoff = hash_cutoffs(df.select(h.alias("h")), "h", [n_test])[0]
    return df.withColumn("split", F.when(h <= cutoff, "test").otherwise("train"))


def split_hashed(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """The one-scan form: every row decides alone, so the share is only close to test_size."""
    cutoff = f"{round(test_size * 16 ** 8):08x}" if test_size < 1 else "g"      # hex digits end at f
    return df.withColumn("split", F.when(F.substring(row_hash(key, seed), 1, 8) < cutoff, "test").otherwise("train"))


def split_stratified(df: DataFrame, key: list[str], target: str, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Per class the same test share: floors first, then the largest remainders until ceil(test_size·n)."""
    h = row_hash(key, seed)
    labelled = df.filter(col(target).isNotNull())
    total = labelled.count()
    wanted = math.ceil(test_size * total)
    counts = labelled.groupBy(col(target).alias("_class")).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.col("n") * F.lit(float(wanted)) / F.lit(total)).withColumn("low", F.floor("share"))
    left = wanted - (shares.agg(F.sum("low")).first()[0] or 0)
    ahead = shares.orderBy(F.desc(F.round(F.col("share") - F.col("low"), 9)), "_class").limit(int(left))
    take = shares.join(ahead.select("_class", F.lit(1).alias("one")), "_class", "left").select(
        "_class", (F.col("low") + F.coalesce("one", F.lit(0))).alias("k"))
    hashes = labelled.select(col(target).alias("_class"), h.alias("h"))
    cutoffs = group_hash_cutoffs(hashes, "h", "_class", take)
    if cutoffs.count() <= FEW_CLASSES:
        known = cutoffs.filter("cutoff IS NOT NULL").collect()
        if not known:
            return df.withColumn("split", F.lit("train"))
        classes = F.lit([r["_class"] for r in known]).cast(T.ArrayType(df.schema[target].dataType))
        cutoff = F.get(F.lit([r["cutoff"] for r in known]), F.array_position(classes, col(target)).cast("int") - 1)
        return df.withColumn("split", F.when(h <= cutoff, "test").otherwise("train"))
    joined = df.join(cutoffs, col(target) == F.col("_class"), "left")
    return joined.withColumn("split", F.when(h <= F.col("cutoff"), "test").otherwise("train")).drop("_class", "cutoff")


def kfold(df: DataFrame, key: list[str], k: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` 0..k-1: contiguous blocks of the hash order, the first n mod k one row longer."""
    n = df.count()
    if n < k:
        raise ValueError(f"Cannot have number of folds k={k} greater than the number of rows: {n}")
    h = row_hash(key, seed)
    ends, at = [], 0
    for i in range(k - 1):
        at += n // k + (1 if i < n % k else 0)
        ends.append(at)
    fold = F.lit(0)
    for c in hash_cutoffs(df.select(h.alias("h")), "h", ends):
        fold = fold + F.when(h > c, 1).otherwise(0)
    return df.withColumn("fold", fold)


def stack_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows together again."""
    return train.unionByName(test)
