"""Session helpers: a session for local runs, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "shoreline") -> SparkSession:
    """A local session for tests and benchmarks (no UI, AQE on)."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.driver.memory", os.environ.get("SHORELINE_DRIVER_MEMORY", "8g"))
            .getOrCreate())


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Uses the folder the context already has, else the session setting.
    Only when both are unset is ``default`` installed; with no default a
    local-mode session (one machine: tests, benchmarks) gets a fresh
    temporary folder, and a cluster session is refused, since a folder on
    one machine would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or default
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="shoreline-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder under the configured ``spark.checkpoint.dir`` base that keeps
    its path across applications (the context's own checkpoint folder gets
    a new random subfolder per application)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/shoreline/{name}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, deleted when the application ends."""
    path = shared_folder(spark, f"{name}-{uuid.uuid4().hex}")
    fs, where = hadoop_path(spark, path)
    fs.deleteOnExit(where)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, where = hadoop_path(spark, path)
    fs.delete(where, True)


def hadoop_path(spark: SparkSession, path: str):
    """The file system of ``path`` and its path there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet under a shared folder and read it back.

    Computed once, lineage cut, and safe against lost executors; later reads
    still prune columns and push filters down.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
