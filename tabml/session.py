"""Session for tests and bench, and the shared scratch folder every job writes below."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tabml", cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """A small local session. On a cluster, use the session the platform hands out."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session that names none gets a folder of its own,
    which goes when Python ends."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tabml-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: later passes scan only the columns
    they need, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def shallow(df: DataFrame) -> DataFrame:
    """The same rows read from their RDD, with its lineage. Plans made from it end here: adaptive execution prints
    the plan below each kept table twice, so that the text of a chain of kept tables doubles with each."""
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), session)


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, when nothing will read it again."""
    path = getattr(df, "scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def open_folder(uri: str):
    """(file system, path) of a folder's address, whatever store it names; for use inside tasks."""
    from pyarrow import fs

    if ":" not in uri:
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(uri)


def write_json(path: str, value) -> None:
    """A small driver-side value (settings, class lists) as a one-line text file."""
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)


def read_json(path: str):
    return json.loads(SparkSession.getActiveSession().read.text(path).first()["value"])
