"""Spark session set-up shared by tests, the bench and the checker.

On a cluster the session already exists and carries its own settings; these helpers only
fill in what is unset, so nothing here overrides a cluster's configuration.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only tables the planner has measured to be small; every explicit broadcast
    # in this package is of a frame with a fixed row bound (thresholds, code lookups, totals).
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "keelson") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("KEELSON_DRIVER_MEMORY", "16g"))
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    # Tests have no cluster folder: give them a scratch one unless a folder is configured.
    if not SparkConf().contains("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="keelson-ckpt-", dir="/tmp"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Fallback folders chosen for sessions that name no checkpoint folder, one per application, so
# every call returns the same folder.
_FALLBACK_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, read from the session.

    The configured folder itself is returned (a stable root for this library's tables); it is
    also registered for RDD checkpoints if none is yet. Only when a local session names no folder
    (a test harness) is a scratch folder created, once per application; on a cluster that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a classic context (Spark Connect)
        sc = None
    if not current and sc is not None:
        current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        key = sc.applicationId
        if key not in _FALLBACK_DIRS:
            existing = sc.getCheckpointDir()
            _FALLBACK_DIRS[key] = existing or tempfile.mkdtemp(prefix="keelson-ckpt-", dir="/tmp")
        current = _FALLBACK_DIRS[key]
    # setCheckpointDir adds a fresh sub-folder on every call: register once only.
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/keelson-out/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under this application's scratch folder."""
    import uuid

    return f"{scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables (call once no DataFrame reads them),
    through the Hadoop file system of the checkpoint folder, so it works on any storage."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def materialize(df, name: str):
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    Used where later steps must all see one evaluation of a plan whose row placement is not a
    pure function of the data (range-partition slices). Survives executor loss, unlike a local
    checkpoint, and runs the plan once, unlike ``DataFrame.checkpoint`` (which evaluates it
    for the count and again for the write).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
