"""Writing tables, reports, models and releases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.tables import shaped

# Write policies and their Spark save modes.
MODES = {"overwrite": "overwrite", "skip": "ignore", "error": "errorifexists"}


def to_parquet(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
    limit: int | None = None,
    if_exists: str = "error",
    compression: str = "zstd",
    row_group_bytes: int = 128 * 1024 * 1024,
    max_records_per_file: int = 0,
    partition_by: Sequence[str] = (),
) -> None:
    """Projected, filtered copy as parquet. Zero rows written is an error."""
    out = shaped(df, columns, where, limit)
    writer = (
        out.write.mode(MODES[if_exists])
        .option("compression", compression)
        .option("parquet.block.size", row_group_bytes)
        .option("maxRecordsPerFile", max_records_per_file)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    spark = df.sparkSession
    existed = if_exists == "skip" and _exists(spark, path)
    writer.parquet(path)
    if not existed and spark.read.schema(out.schema).parquet(path).isEmpty():
        raise RuntimeError(f"no rows written to {path}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def report(df: DataFrame, path: str, fmt: str = "json", if_exists: str = "overwrite") -> None:
    """A result table as csv, json or parquet, one folder per report."""
    writer = df.write.mode(MODES[if_exists])
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")


#: What a release record holds where there is no daily cap: a fixed value of the record's format.
STORED_NO_CAP = 999_999


def stored_cap(value: str) -> int | None:
    """The cap of a release record as the alert operators take it."""
    return None if int(value) == STORED_NO_CAP else int(value)


def release_table(
    spark: SparkSession,
    name: str,
    model_path: str,
    horizon_hours: int,
    threshold: float,
    features: Sequence[str],
    refractory_hours: int = 24,
    daily_alert_cap: int | None = None,
    metrics: DataFrame | None = None,
    lead: DataFrame | None = None,
) -> DataFrame:
    """Release settings plus (one-row) test metrics and lead-time statistics as (release, key, value)."""
    fixed = {
        "model_path": model_path,
        "horizon_hours": horizon_hours,
        "threshold_window": threshold,
        "refractory_hours": refractory_hours,
        "daily_alert_cap": STORED_NO_CAP if daily_alert_cap is None else daily_alert_cap,
        "feature_count": len(features),
        "features": ",".join(features),
    }
    out = spark.createDataFrame([(k, str(v)) for k, v in fixed.items()], "key string, value string")
    for prefix, table in (("test_", metrics), ("lead_", lead)):
        if table is not None:
            pairs = F.explode(
                F.array(*[F.struct(F.lit(prefix + c).alias("k"), F.col(c).cast("string").alias("v")) for c in table.columns])
            )
            out = out.unionByName(table.select(pairs.alias("e")).select(F.col("e.k").alias("key"), F.col("e.v").alias("value")))
    return out.select(F.lit(name).alias("release"), "key", "value")


def settings(spark: SparkSession, values: Mapping[str, object], release: str) -> DataFrame:
    """A small (release, key, value) table from a mapping."""
    rows = [(release, str(k), None if v is None else str(v)) for k, v in values.items()]
    return spark.createDataFrame(rows, "release string, key string, value string")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """File name, size and MD5 of every artifact below a folder (model and report files, not data tables)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"),
        F.col("length").alias("n_bytes"),
        F.md5("content").alias("md5"),
    )
