"""Metrics over (label, prediction[, score]) rows.

Classification metrics come from the (label, prediction) counts: one shuffle of at most
k² partial counts per task, whatever the table size or the skew of the classes. ``by``
evaluates several models or time windows in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabml.functions.columns import col, present
from tabml.functions.ranks import running_totals

OVERFIT_GAP = 0.1     # fixed value
MAX_LABELS = 5_000    # a full matrix has the square of this many cells


def pair_counts(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """(by…, label, prediction, n)."""
    return df.groupBy(*by, col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1_of(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def eval_binary(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """(by…, pos_label, accuracy, precision, recall, f1_score) for the positive class.

    The positive class is the larger of two labels; with any other number of labels it is 1.
    """
    by = list(by)
    counts = pair_counts(df, label, prediction, by)
    group = Window.partitionBy(*by, F.lit(0))
    label_type = counts.schema["label"].dataType
    two = F.size(F.collect_set("label").over(group)) == 2
    positive = F.when(two, F.max("label").over(group)).otherwise(F.lit(1).cast(label_type))
    marked = counts.withColumn("pos_label", positive)
    true, said = F.col("label") == F.col("pos_label"), F.col("prediction") == F.col("pos_label")
    sums = marked.groupBy(*by, "pos_label").agg(
        F.sum("n").alias("n"), _total(F.col("label") == F.col("prediction")).alias("hits"),
        _total(true & said).alias("tp"), _total(said).alias("said"), _total(true).alias("actual"))
    scored = sums.select(*by, "pos_label", ratio(F.col("hits"), F.col("n")).alias("accuracy"),
                         ratio(F.col("tp"), F.col("said")).alias("precision"),
                         ratio(F.col("tp"), F.col("actual")).alias("recall"))
    return scored.withColumn("f1_score", f1_of(F.col("precision"), F.col("recall")))


def per_class(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by…, label, support, predicted, tp, precision, recall, f1_score) from pair counts."""
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    long = counts.select(*by, hit.alias("hit"), F.posexplode(sides).alias("side", "s"))
    sums = long.groupBy(*by, F.col("s.c").alias("label")).agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"),
        F.sum(F.when(F.col("side") == 0, F.col("hit")).otherwise(0)).alias("tp"))
    scored = sums.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("support")))
    return scored.withColumn("f1_score", f1_of(F.col("precision"), F.col("recall")))


def _weighted(name: str) -> Column:
    return ratio(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(name)


def eval_multiclass(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """(by…, accuracy, precision, recall, f1_score), the last three weighted by support."""
    classes = per_class(pair_counts(df, label, prediction, by), by)
    return classes.groupBy(*by).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), _weighted("precision"), _weighted("recall"), _weighted("f1_score"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) for every pair of known labels, zeros included."""
    counts = pair_counts(df, label, prediction)
    sides = counts.select(F.explode(F.array("label", "prediction")).alias("label")).filter("label IS NOT NULL").distinct()
    if sides.count() > MAX_LABELS:
        raise ValueError(f"A confusion matrix over more than {MAX_LABELS} labels has too many cells; use pair_counts")
    known = sides.agg(F.collect_list("label")).scalar()
    grid = sides.select("label", F.explode(known).alias("prediction"))
    return grid.join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(name, precision, recall, f1_score, support): one row per class, accuracy and the two averages."""
    classes = per_class(pair_counts(df, label, prediction))
    metrics = ["precision", "recall", "f1_score"]
    rows = classes.select(F.col("label").cast("string").alias("name"), *metrics, "support")
    hit_rate = ratio(F.sum("tp"), F.sum("support"))
    accuracy = classes.agg(*[hit_rate.alias(m) for m in metrics], F.sum("support").alias("support"))
    macro = classes.agg(*[F.avg(m).alias(m) for m in metrics], F.sum("support").alias("support"))
    weighted = classes.agg(*[_weighted(m) for m in metrics], F.sum("support").alias("support"))
    for name, part in {"accuracy": accuracy, "macro avg": macro, "weighted avg": weighted}.items():
        rows = rows.unionByName(part.select(F.lit(name).alias("name"), *metrics, "support"))
    return rows


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1, by: list[str] = ()) -> DataFrame:
    """(by…, roc_auc): exact area from average ranks over distinct scores; NULL with one class only.
    Rows without a score or label (NULL or NaN) take no part."""
    by = list(by)
    is_positive = col(label) == F.lit(positive)
    scored = df.withColumn("_score", present(df, score)).filter(F.col("_score").isNotNull() & present(df, label).isNotNull())
    distinct = scored.groupBy(*by, "_score").agg(F.count_if(is_positive).alias("pos"), F.count_if(~is_positive).alias("neg"))
    below = running_totals(distinct, "_score", ["neg"], by, spread=scored.select("_score"))
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return below.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def eval_regression(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """(by…, mse, rmse, mae, r2_score)."""
    y = col(label).cast("double")
    error = y - col(prediction).cast("double")
    sums = df.groupBy(*by).agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("spread"))
    r2 = F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(*by, "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2_score"))


def as_long(metrics: DataFrame, by: list[str] = (), digits: int | None = 4) -> DataFrame:
    """Wide metric columns to (by…, metric, value)."""
    names = [c for c in metrics.columns if c not in by]
    value = {n: F.round(col(n).cast("double"), digits) if digits is not None else col(n).cast("double") for n in names}
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), value[n].alias("value")) for n in names])
    return metrics.select(*by, F.explode(cells).alias("c")).select(*by, "c.metric", "c.value")


def evaluate(df: DataFrame, task: str, label: str = "label", prediction: str = "prediction",
             score: str | None = None, by: list[str] = (), silhouette_form: str = "silhouette_score") -> DataFrame:
    """Wide metrics for the task type."""
    if task == "binary_classification":
        metrics = eval_binary(df, label, prediction, by)
        if score is None:
            return metrics.drop("pos_label")
        area = roc_auc(df, label, score, by=by)
        if by:
            return metrics.drop("pos_label").join(area, list(by), "left")
        return metrics.drop("pos_label").withColumn("roc_auc", area.select("roc_auc").scalar())
    if task == "multiclass_classification":
        return eval_multiclass(df, label, prediction, by)
    if task == "regression":
        return eval_regression(df, label, prediction, by)
    if task == "clustering":
        from tabml.operators.cluster_metrics import evaluate_clusters
        return evaluate_clusters(df, "features", prediction, silhouette_form)
    raise ValueError(f"Unknown task type: {task}")


def verdict(metrics: DataFrame, task: str) -> DataFrame:
    """(metric, value, text): rounded metrics with the sentence that reads them. Clusters are read by
    the silhouette that the metrics hold."""
    shape = "silhouette_squared" if "silhouette_squared" in metrics.columns else "silhouette_score"
    percent, four = "%.1f%%", "%.4f"
    # fixed values: sentences and limits of the reports
    sentences = {
        "binary_classification": {
            "accuracy": f"The model correctly predicts {percent} of all samples",
            "precision": f"Of samples predicted as positive, {percent} are actually positive",
            "recall": f"The model correctly identifies {percent} of all positive samples",
            "f1_score": f"F1 score of {four} provides balanced precision-recall measure",
        },
        "multiclass_classification": {
            "accuracy": f"The model correctly predicts {percent} of all samples",
            "precision": f"Weighted precision of {percent} across all classes",
            "recall": f"Weighted recall of {percent} across all classes",
            "f1_score": f"Weighted F1 score of {four} across all classes",
        },
        "regression": {
            "r2_score": f"The model explains {percent} of the variance in the target",
            "rmse": f"Average prediction error is {four} units",
            "mae": f"Mean absolute error is {four} units",
        },
        "clustering": {
            shape: f"Silhouette score of {four} indicates cluster quality",
            "calinski_harabasz_score": f"Calinski-Harabasz score of {four} indicates cluster separation",
            "n_clusters": "Model identified %.0f clusters",
        },
    }[task]
    leading, limit, good, poor = {
        "binary_classification": ("accuracy", 0.8, "Good performance", "Needs improvement"),
        "multiclass_classification": ("accuracy", 0.8, "Good performance", "Needs improvement"),
        "regression": ("r2_score", 0.7, "Good fit", "Needs improvement"),
        "clustering": (shape, 0.5, "Good clustering", "Clusters may need refinement"),
    }[task]
    long = as_long(metrics.select([m for m in metrics.columns if m in sentences or m == "mse"]), digits=None)
    text = F.lit(None).cast("string")
    for name, sentence in sentences.items():
        shown = F.col("value") * 100 if percent in sentence else F.col("value")
        text = F.when(F.col("metric") == name, F.format_string(sentence, shown)).otherwise(text)
    overall = metrics.select(F.lit("overall").alias("metric"), F.round(leading, 4).alias("value"),
                             F.when(F.col(leading) > limit, good).otherwise(poor).alias("text"))
    return long.select("metric", F.round("value", 4).alias("value"), text.alias("text")).unionByName(overall)


def overfit_flag(scores: DataFrame, train: str = "train_score", test: str = "test_score") -> DataFrame:
    """Adds the reading of the gap between train and test score."""
    gap = col(train) > col(test) + OVERFIT_GAP
    return scores.withColumn("overfitting", F.when(gap, "Model shows overfitting").otherwise("Model generalizes well"))
