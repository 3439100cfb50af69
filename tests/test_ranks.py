import hashlib

import numpy as np
from pyspark.sql import functions as F

from tabml.functions import ranks


def skewed(spark, n=4000):
    """A third of the rows share one value; the rest spread out; some are missing or NaN."""
    i = F.col("id")
    value = F.when(i % 3 == 0, 7.0).when(i % 50 == 1, None).when(i % 50 == 2, float("nan")).otherwise((i * 7919) % 10007 / 10)
    return spark.range(n).select("id", value.alias("x"), (i % 11).alias("y"), F.lit(None).cast("double").alias("z"))


def expected(df, column, probabilities):
    values = np.array([r[0] for r in df.select(column).collect() if r[0] is not None and r[0] == r[0]], dtype=float)
    return list(np.quantile(values, probabilities))


def test_one_pass_and_bracketed_quantiles_agree_with_numpy(spark, monkeypatch):
    df = skewed(spark).cache()
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    monkeypatch.setattr(ranks, "BRACKET_ROWS", 5)
    monkeypatch.setattr(ranks, "SKETCH_ACCURACY", 50)
    for limit in (10 ** 9, 0):
        found = ranks.exact_quantiles(df, ["x", "y", "z"], probabilities, one_pass_rows=limit)
        assert np.allclose(found["x"], expected(df, "x", probabilities))
        assert np.allclose(found["y"], expected(df, "y", probabilities))
        assert found["z"] == [None] * len(probabilities)


def test_hash_cutoffs_are_order_statistics(spark):
    df = spark.range(500).select(ranks.row_hash(["id"], 42).alias("h"))
    ordered = sorted(hashlib.md5(f"{i}|42".encode()).hexdigest() for i in range(500))
    assert ranks.hash_cutoffs(df, "h", [1, 100, 500]) == [ordered[0], ordered[99], ordered[499]]


def test_running_totals_in_many_buckets(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 37) % 1000).alias("o"), (F.col("id") % 5).alias("s"))
    for bucket_rows in (10 ** 6, 50):
        rows = ranks.running_totals(df, "o", ["s"], ["g"], bucket_rows=bucket_rows).collect()
        assert len(rows) == 1000
        for g in (0, 1):
            total = 0
            for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["o"]):
                assert r["s_before"] == total
                total += r["s"]
