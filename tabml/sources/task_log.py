"""Task logs: JSON objects keyed by task id, with the benchmark results nested inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = """struct<id: string, type: string, status: string, params: map<string, string>, created_at: timestamp_ntz,
 started_at: timestamp_ntz, completed_at: timestamp_ntz, result: struct<task_type: string, best_model_name: string,
 best_score: double, best_metric: string, all_results: map<string, map<string, string>>, n_samples: bigint,
 n_features: bigint>, error: string, progress: bigint>"""


def read_task_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per task of every log file."""
    whole = spark.read.text(path, wholetext=True)
    tasks = whole.select(F.explode(F.from_json("value", f"map<string, {RECORD}>")).alias("task_id", "task"))
    return tasks.select("task_id", "task.*").drop("id")


def task_status(log: DataFrame, task_id: str) -> DataFrame:
    """(task_id, status, progress, error, seconds) of one task."""
    return with_seconds(log.filter(F.col("task_id") == task_id)).select("task_id", "status", "progress", "error", "seconds")


def with_seconds(log: DataFrame) -> DataFrame:
    seconds = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return log.withColumn("seconds", seconds)


def task_leaderboard(log: DataFrame) -> DataFrame:
    """(task_id, task_type, model, metric, value, error): the nested results as a long table."""
    models = log.select("task_id", "result.task_type", F.explode("result.all_results").alias("model", "metrics"))
    cells = models.select("task_id", "task_type", "model", F.explode("metrics").alias("metric", "text"))
    failed = F.col("metric") == "error"
    return cells.select("task_id", "task_type", "model", F.when(~failed, F.col("metric")).alias("metric"),
                        F.when(~failed, F.col("text").try_cast("double")).alias("value"), F.when(failed, F.col("text")).alias("error"))
