"""The width of the RBF kernel."""

from __future__ import annotations

import numpy as np
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaled_gamma(prepared: DataFrame, features: str = "features") -> tuple[float, int]:
    """(1 / (d · variance of all feature values), d): the usual default width of the kernel."""
    row = prepared.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).first()["s"]
    mean, variance, n = np.array(row["mean"]), np.array(row["variance"]), row["count"]
    within = variance * (n - 1) / n if n else variance
    spread = float((within + mean ** 2).mean() - mean.mean() ** 2)
    return (1.0 / (len(mean) * spread) if spread > 0 else 1.0), len(mean)
