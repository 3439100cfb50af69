"""What drives a model: built-in importances, coefficients, and permutation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabml.functions.columns import col
from tabml.functions.ranks import row_hash
from tabml.operators import evaluate as E
from tabml.session import materialize

TOP = 5                     # fixed value: features listed in a report
SHUFFLE_ROWS = 100_000      # rows of a range of the hash order, about; the result does not depend on it


def _last(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def _ranked(table: DataFrame, size: str, top: int | None) -> DataFrame:
    order = Window.orderBy(F.desc(size), "feature")       # one row per feature
    ranked = table.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def importance_tree(spark, model, slots: list[tuple[str, str]], top: int | None = TOP, by_source: bool = False) -> DataFrame:
    """(feature, importance, rank) of a tree model, per output slot or summed per source column."""
    values = _last(model).featureImportances.toArray().tolist()
    table = spark.createDataFrame([(n, s, v) for (n, s), v in zip(slots, values)], "name string, source string, importance double")
    grouped = table.groupBy(F.col("source" if by_source else "name").alias("feature")).agg(F.sum("importance").alias("importance"))
    return _ranked(grouped, "importance", top)


def importance_coef(spark, model, slots: list[tuple[str, str]], top: int | None = TOP) -> DataFrame:
    """(feature, coefficient, abs_coefficient, rank) of a linear model; several classes give one row each."""
    fitted = _last(model)
    try:
        matrix = fitted.coefficientMatrix.toArray().tolist()
    except AttributeError:
        matrix = [fitted.coefficients.toArray().tolist()]
    rows = [(n if len(matrix) == 1 else f"{n}|class {i}", float(v)) for i, row in enumerate(matrix) for (n, _), v in zip(slots, row)]
    table = spark.createDataFrame(rows, "feature string, coefficient double").withColumn("abs_coefficient", F.abs("coefficient"))
    return _ranked(table, "abs_coefficient", top)


def importance(spark, model, slots: list[tuple[str, str]], top: int | None = TOP) -> DataFrame:
    """(method, feature, importance, rank) by what the model offers; one row that says so if nothing."""
    # fixed values: method names of the reports
    tree, linear, nothing = "Tree-based feature importance", "Linear model coefficients", "Not available"
    fitted = _last(model)
    on_slots = getattr(fitted, "numFeatures", len(slots)) == len(slots)     # kernel features have no names
    if on_slots and hasattr(fitted, "featureImportances"):
        return importance_tree(spark, model, slots, top).select(F.lit(tree).alias("method"), "feature", "importance", "rank")
    if on_slots and (hasattr(fitted, "coefficients") or hasattr(fitted, "coefficientMatrix")):
        return importance_coef(spark, model, slots, top).select(
            F.lit(linear).alias("method"), "feature", F.col("abs_coefficient").alias("importance"), "rank")
    return spark.createDataFrame([(nothing, "Use permutation importance for a model-agnostic approach.", None, None)],
                                 "method string, feature string, importance double, rank int")


def permuted(df: DataFrame, key: list[str], features: list[str], seed: int = 42,
             shuffle_rows: int = SHUFFLE_ROWS) -> DataFrame:
    """All rows once as they are (feature NULL) and once per feature with that column shuffled.

    In an order drawn anew for each feature (by a hash of the key) every row takes the value of the
    next row, the last one that of the first. The order is cut into ranges of about ``shuffle_rows``
    rows; the last row of a range takes the first value of the next range that has rows, so the
    result is the same however many ranges there are and no task orders the whole table. Only hash, row
    number and value move for a feature; the rows themselves are written once and scanned once.
    """
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "permuted")
    ranges = max(1, -(-rows.count() // shuffle_rows))
    dealt = rows
    for i, f in enumerate(features):
        narrow = rows.select("_row", row_hash(key, f"{seed}|{f}").alias("_hash"), F.struct(col(f).alias("v")).alias("_value"))
        share = F.conv(F.substring("_hash", 1, 12), 16, 10).cast("double") / float(16 ** 12)
        narrow = narrow.withColumn("_range", F.floor(share * ranges))
        order = Window.partitionBy("_range").orderBy("_hash")
        firsts = narrow.groupBy("_range").agg(F.min_by("_value", "_hash").alias("_first"))     # one row per range
        along = Window.orderBy("_range")
        whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        following = firsts.select("_range", F.coalesce(F.lead("_first").over(along), F.first("_first").over(whole)).alias("_after"))
        taken = narrow.withColumn("_own", F.lead("_value").over(order)).join(following, "_range")
        dealt = dealt.join(taken.select("_row", F.coalesce("_own", "_after")["v"].alias(f"_next_{i}")), "_row")
    keep = [c for c in df.columns if c not in features]
    versions = [F.struct(F.lit(None).cast("string").alias("_feature"), *[col(f).alias(f) for f in features])]
    for i, f in enumerate(features):
        versions.append(F.struct(F.lit(f).alias("_feature"),
                                 *[(F.col(f"_next_{i}") if g == f else col(g)).alias(g) for g in features]))
    return dealt.select(*[col(c) for c in keep], F.explode(F.array(*versions)).alias("_v")).select(
        *[col(c) for c in keep], "_v.*")


def importance_permutation(df: DataFrame, key: list[str], features: list[str], score, task: str,
                           label: str = "label", seed: int = 42) -> DataFrame:
    """(feature, importance, rank): how much the score drops when the column is shuffled.

    ``score(df)`` adds ``prediction`` to rows that hold the feature columns.
    """
    metric = "r2_score" if task == "regression" else "accuracy"
    scored = score(permuted(df, key, features, seed))
    by_feature = E.evaluate(scored, task, label, by=["_feature"]).select("_feature", F.col(metric).alias("s"))
    # d + 1 rows from here on
    base = F.max(F.when(F.col("_feature").isNull(), F.col("s"))).over(Window.partitionBy(F.lit(0)))
    drops = by_feature.withColumn("base", base).filter("_feature IS NOT NULL").select(
        F.col("_feature").alias("feature"), (F.col("base") - F.col("s")).alias("importance"))
    return _ranked(drops, "importance", None)
