"""Contributions of features to single predictions, for all rows at once.

Both sampled Shapley values (Štrumbelj & Kononenko 2014) and local surrogates (LIME, Ribeiro
et al. 2016) score mixtures of a row with background rows and combine the scores linearly.
The mixtures and the combination weights are drawn once and are the same for every row. They
form a small plan table (one row per mixture: mask, background values, weights), broadcast once,
so plans stay small however many features and samples there are: each row meets every mixture,
is scored, and weighted sums are taken per row, most of them before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.functions.columns import col
from tabml.functions.ranks import row_hash

BACKGROUND_ROWS = 100    # fixed value: rows that stand for "the feature is unknown", unless told otherwise
MAX_PLAN_CELLS = 20_000_000     # mixtures times features of a plan, which bounds the broadcast


def background_rows(df: DataFrame, key: list[str], features: list[str], rows: int = BACKGROUND_ROWS, seed: int = 42) -> list:
    """A bounded, repeatable draw of feature rows."""
    return df.orderBy(row_hash(key, seed)).limit(rows).select([col(f) for f in features]).collect()


def _plan(df: DataFrame, features: list[str], masks: np.ndarray, background: list, weights: np.ndarray, base: np.ndarray) -> DataFrame:
    """(_s, _mask, _other, _weights, _base): one row per mixture."""
    if masks.size > MAX_PLAN_CELLS:
        raise ValueError(f"{masks.shape[0]} mixtures of {masks.shape[1]} features exceed {MAX_PLAN_CELLS} cells; ask for fewer samples")
    other = T.StructType([T.StructField(f"f{j}", df.schema[f].dataType) for j, f in enumerate(features)])
    schema = T.StructType([T.StructField("_s", T.IntegerType()), T.StructField("_mask", T.ArrayType(T.BooleanType())), T.StructField("_other", other),
                           T.StructField("_weights", T.ArrayType(T.DoubleType())), T.StructField("_base", T.DoubleType())])
    rows = [(s, m.tolist(), tuple(b), w.tolist(), float(x)) for s, (m, b, w, x) in enumerate(zip(masks, background, weights, base))]
    return df.sparkSession.createDataFrame(rows, schema)


def _explained(df: DataFrame, key: list[str], features: list[str], output, plan: DataFrame, mixtures: int, value: str) -> DataFrame:
    """(key…, feature, value, base_value): weighted sums of the scores of a row's mixtures, in
    which the row's values stand where the mask is set and background values elsewhere."""
    rows = df.select(*[col(k) for k in key], *[col(f) for f in features if f not in key])
    asked = rows.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(mixtures - 1))))
    mixed = asked.join(F.broadcast(plan), "_s")
    mixed = mixed.withColumns({f: F.when(F.get("_mask", F.lit(j)), col(f)).otherwise(F.col(f"_other.f{j}")) for j, f in enumerate(features)})
    scores = output(mixed.drop("_mask", "_other")).select(*key, "_weights", "_base", "output")
    cells = F.posexplode(F.concat("_weights", F.array("_base")))
    sums = scores.select(*key, "output", cells.alias("_j", "_w")).groupBy(*key, "_j").agg(F.sum(F.col("output") * F.col("_w")).alias("_v"))
    whole = sums.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_j", "_v"))).alias("_sums"))
    names = F.lit(list(features))
    each = F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda j: F.struct(
        F.get(names, j).alias("feature"), F.try_element_at("_sums", j).alias(value)))
    return whole.select(*key, F.explode(each).alias("_c"), F.try_element_at("_sums", F.lit(len(features))).alias("base_value")).select(
        *key, "_c.*", "base_value")


def shapley_plan(n_features: int, n_background: int, samples: int, seed: int):
    """Masks, background numbers and weights: each sample adds the features in a random order."""
    random = np.random.RandomState(seed)
    masks, numbers, weights, base = [], [], [], []
    for s in range(samples):
        order = random.permutation(n_features)
        mask = np.zeros(n_features, dtype=bool)
        for step in range(n_features + 1):
            w = np.zeros(n_features)
            if step > 0:
                mask[order[step - 1]] = True
                w[order[step - 1]] += 1.0 / samples
            if step < n_features:
                w[order[step]] -= 1.0 / samples
            masks.append(mask.copy())
            numbers.append(s % n_background)
            weights.append(w)
            base.append(1.0 / samples if step == 0 else 0.0)
    return np.array(masks), numbers, np.array(weights), np.array(base)


def shapley_sampled(df: DataFrame, key: list[str], features: list[str], output, background: list,
                    samples: int = 50, seed: int = 42) -> DataFrame:
    """(key…, feature, contribution, base_value) for any model; contributions of a row and the
    base value add up to its output. ``output(df)`` adds ``output`` to rows of feature columns."""
    samples = max(samples, len(background))         # every background row takes part
    masks, numbers, weights, base = shapley_plan(len(features), len(background), samples, seed)
    plan = _plan(df, features, masks, [background[i] for i in numbers], weights, base)
    return _explained(df, key, features, output, plan, len(masks), "contribution")


def shapley_linear(prepared: DataFrame, key: list[str], coefficients: list[float], intercept: float,
                   names: list[str], means: list[float]) -> DataFrame:
    """(key…, feature, contribution, base_value) of a linear model, exactly: w·(x - mean)."""
    w, m = F.lit([float(c) for c in coefficients]), F.lit([float(x) for x in means])
    base = intercept + sum(c * x for c, x in zip(coefficients, means))
    cells = prepared.select(*key, F.posexplode(vector_to_array("features")).alias("_i", "_x"))
    place = F.col("_i") + 1
    return cells.select(*key, F.try_element_at(F.lit(names), place).alias("feature"),
                        (F.try_element_at(w, place) * (F.col("_x") - F.try_element_at(m, place))).alias("contribution"),
                        F.lit(float(base)).alias("base_value"))


def shapley_global(contributions: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute contribution over the rows."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def surrogate_plan(n_features: int, n_background: int, samples: int, seed: int):
    """Masks, background numbers, and the matrix that turns scores into surrogate weights.

    Kernel sqrt(exp(-r/w²)) with r replaced features and w = 0.75·sqrt(d); weighted ridge
    regression (penalty 1) on the masks, so the weights are linear in the scores.
    """
    random = np.random.RandomState(seed)
    masks = random.randint(0, 2, size=(samples, n_features)).astype(bool)
    masks[0] = True
    numbers = random.randint(0, n_background, samples).tolist()
    width = 0.75 * np.sqrt(n_features)
    kernel = np.sqrt(np.exp(-(~masks).sum(axis=1) / width ** 2))
    z = masks.astype(float)
    centre = (kernel[:, None] * z).sum(axis=0) / kernel.sum()
    centred = z - centre
    gram = centred.T @ (kernel[:, None] * centred) + np.eye(n_features)
    weights = np.linalg.solve(gram, centred.T * kernel).T
    base = kernel / kernel.sum() - weights @ centre
    return masks, numbers, weights, base


def surrogate_local(df: DataFrame, key: list[str], features: list[str], output, background: list,
                    num_features: int = 10, samples: int = 200, seed: int = 42) -> DataFrame:
    """(key…, feature, weight, place, base_value): per row the features with the largest weights in
    a linear model fitted around the row."""
    masks, numbers, weights, base = surrogate_plan(len(features), len(background), samples, seed)
    plan = _plan(df, features, masks, [background[i] for i in numbers], weights, base)
    long = _explained(df, key, features, output, plan, len(masks), "weight")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.abs("weight")), "feature"))
    return long.withColumn("place", place).filter(F.col("place") <= num_features)
