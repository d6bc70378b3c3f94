"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def _configured(name: str) -> bool:
    """Whether the defaults file or a running session already has a setting."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active.conf.get(name, None) is not None
    return SparkConf(loadDefaults=True).get(name) is not None


def build_session(app: str = "panelwatch", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE, skew handling and UTC; cluster settings given outside win."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("DRIVER_MEM", "12g"))
    if master and master.startswith("local[") and not _configured("spark.checkpoint.dir"):
        b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-ckpt-"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables, named by the cluster in ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder (survives lost executors)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
