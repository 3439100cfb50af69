"""Quality over time. The windowed forms are one aggregation, so they run on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.functions.columns import col
from tabml.operators.evaluate import f1_of, ratio

LIMIT = 0.7                  # fixed value: scores below raise a warning
EVERY = "30 minutes"         # fixed value: how often quality is looked at


def threshold(scores: DataFrame, score: str = "test_score", limit: float = LIMIT) -> DataFrame:
    """Adds (status, message)."""
    low = col(score) < limit
    # fixed values: texts of the two outcomes
    message = F.when(low, F.concat(F.lit("Model performance below threshold: "), col(score).cast("string"))).otherwise(
        "Model performance OK")
    return scores.withColumn("status", F.when(low, "warning").otherwise("healthy")).withColumn("message", message)


def windowed_quality(scored: DataFrame, time: str, label: str = "label", prediction: str = "prediction",
                     every: str = EVERY, positive=1) -> DataFrame:
    """(start, end, n, accuracy, precision, recall, f1_score, status) per time window."""
    true, said = col(label) == F.lit(positive), col(prediction) == F.lit(positive)
    sums = scored.groupBy(F.window(col(time), every).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(col(label) == col(prediction)).alias("hits"), F.count_if(true & said).alias("tp"),
        F.count_if(said).alias("said"), F.count_if(true).alias("actual"))
    parts = sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n",
                        ratio(F.col("hits"), F.col("n")).alias("accuracy"), ratio(F.col("tp"), F.col("said")).alias("precision"),
                        ratio(F.col("tp"), F.col("actual")).alias("recall"))
    return parts.withColumn("f1_score", f1_of(F.col("precision"), F.col("recall"))).withColumn(
        "status", F.when(F.col("accuracy") < LIMIT, "warning").otherwise("healthy"))


def baseline(train: DataFrame, column: str) -> dict[str, float]:
    """Mean, sample std and missing rate of a training column."""
    row = train.agg(F.avg(col(column)).alias("mean"), F.stddev_samp(col(column)).alias("std"),
                    (F.count_if(col(column).isNull()) / F.count(F.lit(1))).alias("missing")).first()
    return row.asDict()


def windowed_drift(rows: DataFrame, time: str, column: str, known: dict[str, float], every: str = EVERY) -> DataFrame:
    """(start, end, n, mean, missing, shift, missing_change): windows against the training column;
    shift is the difference of the means in training standard deviations."""
    sums = rows.groupBy(F.window(col(time), every).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(col(column)).alias("mean"), F.count_if(col(column).isNull()).alias("gaps"))
    missing = F.col("gaps") / F.col("n")
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", missing.alias("missing"),
                       ratio(F.col("mean") - F.lit(known["mean"]), F.lit(known["std"])).alias("shift"),
                       (missing - F.lit(known["missing"])).alias("missing_change"))
