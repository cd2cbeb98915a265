"""SparkSession factory for local runs; on a cluster the submitting tool owns the session."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "quarrymill", *, cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", shared_dir: str | None = None) -> SparkSession:
    """A local session: UTC, Arrow on, AQE on, no UI. shared_dir: what spark.checkpoint.dir is to name."""
    builder = SparkSession.builder
    if shared_dir:
        builder = builder.config("spark.checkpoint.dir", shared_dir)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir, deleted when the driver ends. Where that
    is unset a local folder serves a local master; on a cluster it has to be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    name = f"{(named or 'file:///tmp/checkpoints/quarrymill').rstrip('/')}/{label}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(name)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return name
