"""The model registry as an append-only table of events.

Rows are never changed: saving, activating, deploying and deleting each append an event, and
the current state is an aggregate over them. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabml.functions.ranks import running_totals

KEEP_DAYS = 30      # fixed value: older versions are cleaned up
SCHEMA = """id bigint, event string, model_name string, version string, file_path string, task_type string,
 target_column string, accuracy double, f1_score double, r2_score double, n_samples bigint, n_features bigint,
 model_type string, created_at timestamp_ntz, description string, tags string"""
VERSION = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(", ")][2:]


def saves(events: DataFrame) -> DataFrame:
    return events.filter("event = 'save'")


def auto_version(c):
    """vYYYYmmdd_HHMMSS."""
    return F.concat(F.lit("v"), F.date_format(c, "yyyyMMdd_HHmmss"))


def tags_json(c):
    """Comma-separated text to a JSON list of trimmed tags; no text, no tags."""
    parts = F.transform(F.split(c, ","), lambda t: F.trim(t))
    return F.to_json(F.when((c.isNull()) | (c == ""), F.array().cast("array<string>")).otherwise(parts))


def save_versions(events: DataFrame, candidates: DataFrame, models_dir: str = "models") -> DataFrame:
    """New save events for candidates whose (model_name, version) is not taken.

    Candidates hold model_name, version (NULL: from the time), created_at, tags (comma text),
    description, task facts, and metrics as ``training_<metric>`` / ``evaluation_<metric>``;
    the training value wins unless it is missing or 0. Of equal names the earliest is kept.
    """
    def metric(m):
        training = F.col(f"training_{m}")
        return F.coalesce(F.when(training != 0, training), F.col(f"evaluation_{m}")).alias(m)

    version = F.coalesce(F.when(F.col("version") != "", F.col("version")), auto_version("created_at"))
    rows = candidates.withColumn("version", version).select(
        "model_name", "version", F.concat(F.lit(models_dir + "/"), "model_name", F.lit("_"), "version").alias("file_path"),
        "task_type", "target_column", metric("accuracy"), metric("f1_score"), metric("r2_score"), "n_samples", "n_features",
        "model_type", "created_at", F.coalesce("description", F.lit("")).alias("description"), tags_json(F.col("tags")).alias("tags"))
    rest = [c for c in VERSION if c not in ("model_name", "version", "created_at")]
    first = rows.groupBy("model_name", "version").agg(F.min(F.struct("created_at", *rest)).alias("r")).select(
        "model_name", "version", "r.*")
    fresh = first.join(saves(events).select("model_name", "version"), ["model_name", "version"], "left_anti")
    return _numbered(fresh, events)


def _numbered(fresh: DataFrame, events: DataFrame) -> DataFrame:
    """Ids in order of time, continuing after the highest id, without ordering all rows in one task."""
    timed = fresh.withColumn("_at", F.unix_micros(F.col("created_at").cast("timestamp")))
    moments = timed.groupBy("_at").agg(F.count(F.lit(1)).alias("n"))
    before = running_totals(moments, "_at", ["n"]).select("_at", "n_before")
    same_time = F.row_number().over(Window.partitionBy("_at").orderBy("model_name", "version"))
    highest = events.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return timed.join(before, "_at").withColumn("id", highest + F.col("n_before") + same_time).withColumn(
        "event", F.lit("save")).select("id", "event", *VERSION)


def _mark(events: DataFrame, ids: DataFrame, event: str, at) -> DataFrame:
    """An event row for every id that names a living version."""
    return living(events).join(ids.select("id").distinct(), "id", "left_semi").select(
        "id", F.lit(event).alias("event"), *[c for c in VERSION if c != "created_at"]).withColumn(
        "created_at", at).select("id", "event", *VERSION)


def activate(events: DataFrame, ids: DataFrame, at) -> DataFrame:
    return _mark(events, ids, "activate", at)


def deploy(events: DataFrame, ids: DataFrame, at) -> DataFrame:
    return _mark(events, ids, "deploy", at)


def delete(events: DataFrame, ids: DataFrame, at) -> DataFrame:
    return _mark(events, ids, "delete", at)


def living(events: DataFrame) -> DataFrame:
    """Saved versions that were not deleted."""
    return saves(events).join(events.filter("event = 'delete'").select("id"), "id", "left_anti")


def list_models(events: DataFrame) -> DataFrame:
    """All living versions, tags parsed, with is_active and is_deployed; order by created_at for newest first.

    An activation makes its version the only active one; versions saved later start active.
    """
    known = events.filter("event = 'activate'").join(saves(events).select("id"), "id", "left_semi")
    last = known.agg(F.max(F.struct("created_at", "id"))).scalar()
    deployed = events.filter("event = 'deploy'").groupBy("id").agg(F.lit(True).alias("_deployed"))
    rows = living(events).withColumn("_last", last)
    active = F.col("_last").isNull() | (F.col("id") == F.col("_last.id")) | (F.col("created_at") > F.col("_last.created_at"))
    return (rows.join(deployed, "id", "left")
            .withColumn("tags", F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>")))
            .withColumn("is_active", active).withColumn("is_deployed", F.coalesce("_deployed", F.lit(False)))
            .drop("_last", "_deployed", "event"))


def newest_first(models: DataFrame) -> DataFrame:
    return models.orderBy(F.desc("created_at"), F.desc("id"))


def model_details(events: DataFrame, model_id: int) -> DataFrame:
    return list_models(events).filter(F.col("id") == model_id)


def expired(events: DataFrame, as_of, days: int = KEEP_DAYS) -> DataFrame:
    """Living versions created more than ``days`` before ``as_of``."""
    return living(events).filter(F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))).select(
        "id", "model_name", "version", "file_path", "created_at")


def append(events: DataFrame, path: str) -> None:
    events.select("id", "event", *VERSION).write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table at ``path``; empty before the first event."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def save_version(trained, events_path: str, models_dir: str, model_name: str, version: str | None = None, tags: str = "",
                 description: str = "", metrics: dict[str, float] | None = None, n_samples: int | None = None) -> int:
    """Write the model below ``models_dir`` and append its save event; returns the new id. A version
    that exists is refused."""
    spark = SparkSession.getActiveSession()
    events = read_events(spark, events_path)
    names = [f"{p}_{m}" for p in ("training", "evaluation") for m in ("accuracy", "f1_score", "r2_score")]
    values = [float(metrics[m]) if metrics and metrics.get(m) is not None else None for m in ("accuracy", "f1_score", "r2_score")] + [None] * 3
    facts = spark.createDataFrame(
        [(model_name, version, tags, description, trained.task, trained.target, *values, n_samples, len(trained.features), trained.name)],
        "model_name string, version string, tags string, description string, task_type string, target_column string, "
        + ", ".join(f"{n} double" for n in names) + ", n_samples bigint, n_features bigint, model_type string")
    new = save_versions(events, facts.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")), models_dir).collect()
    if not new:
        raise ValueError(f"Version {version} of {model_name} exists")
    trained.save(new[0]["file_path"])
    append(spark.createDataFrame(new, SCHEMA), events_path)
    return new[0]["id"]


def load_version(spark: SparkSession, events_path: str, model_id: int):
    """The model behind a living version, which becomes the active one."""
    from tabml.plans.train import load_trained
    events = read_events(spark, events_path)
    row = living(events).filter(F.col("id") == model_id).first()
    if row is None:
        raise ValueError(f"Model {model_id} not found")
    trained = load_trained(spark, row["file_path"])
    ids = spark.createDataFrame([(model_id,)], "id bigint")
    append(activate(events, ids, F.current_timestamp().cast("timestamp_ntz")), events_path)
    return trained
