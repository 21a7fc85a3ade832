"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app: str = "tidegauge", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators assume. Values passed by name win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Times are zone-free, so every cast between text, NTZ and instants must use one zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The work folder that every executor can reach: the session's ``spark.checkpoint.dir``. Without one this fails."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def local_work_dir(spark: SparkSession) -> None:
    """Give a local session without a work folder one that lasts as long as the process. A cluster must name its own."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        folder = tempfile.mkdtemp(prefix="tidegauge-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh location below the shared folder."""
    return f"{shared_dir(spark)}/tidegauge/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Used where several jobs re-read one table. The files outlive a lost executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
