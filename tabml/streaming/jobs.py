"""Streams of files: read, score, watch. Scoring is stateless; only window metrics hold state,
bounded by the watermark (rows later than the delay are dropped)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.functions.columns import col
from tabml.operators.monitor import EVERY, windowed_drift, windowed_quality


def read_stream(spark: SparkSession, folder: str, schema, file_format: str = "parquet", pattern: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Records that arrive as files (Parquet, JSON lines, CSV) in a folder."""
    reader = spark.readStream.schema(schema).format(file_format)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def event_time(stream: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """Watermark on the time column; zone-less timestamps are read as session time first."""
    if isinstance(stream.schema[time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(time, col(time).cast("timestamp"))
    return stream.withWatermark(time, delay)


def score_stream(trained, stream: DataFrame) -> DataFrame:
    """Predictions for an unbounded table, by the code that scores batches. Models that compare rows
    with stored rows (neighbours) can't be part of a stream's plan: see ``score_available``."""
    return trained.predict(stream)


def score_available(trained, stream: DataFrame, path: str, checkpoint: str) -> None:
    """Score everything that has arrived, micro-batch by micro-batch, with any model, and stop. A
    batch that is repeated after a failure overwrites its own folder."""
    def one(batch: DataFrame, number: int) -> None:
        trained.predict(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def quality_stream(scored: DataFrame, time: str, label: str = "label", prediction: str = "prediction",
                   delay: str = "10 minutes", every: str = EVERY) -> DataFrame:
    return windowed_quality(event_time(scored, time, delay), time, label, prediction, every)


def drift_stream(rows: DataFrame, time: str, column: str, known: dict[str, float],
                 delay: str = "10 minutes", every: str = EVERY) -> DataFrame:
    return windowed_drift(event_time(rows, time, delay), time, column, known, every)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that has arrived, append it to ``path``, and stop.

    Windows appear once the watermark has passed their end; the checkpoint lets the next run go on.
    """
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def closed_windows(windows: DataFrame, rows: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """The windows of a batch result that a stream over the same rows has already emitted."""
    seen = rows.agg(F.max(col(time).cast("timestamp")) - F.expr(f"INTERVAL {delay}")).scalar()
    return windows.filter(F.col("end") <= seen)
