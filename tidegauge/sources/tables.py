"""Reading tables: by name from delimited files, or by column from parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.sources.schemas import RAW

AREAS = ("hosp", "icu")


def _folder(root: str, area: str | None) -> str:
    if area is None:
        return root
    if area.lower() not in AREAS:
        raise ValueError(f"unknown area {area!r}, expected one of {AREAS}")
    return f"{root.rstrip('/')}/{area.lower()}"


def _files(spark: SparkSession, folder: str, recursive: bool) -> list[str]:
    """File names under a folder on whatever file system Spark is configured for. Names only, no data."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    walker = fs.listFiles(path, recursive)
    found = []
    while walker.hasNext():
        found.append(walker.next().getPath().toString())
    return sorted(found)


def _table_of(file: str) -> str | None:
    name = file.rsplit("/", 1)[-1]
    for ending in (".csv.gz", ".csv"):
        if name.endswith(ending):
            return name[: -len(ending)]
    return None


def list_tables(spark: SparkSession, root: str, area: str | None = "hosp") -> DataFrame:
    """Distinct table names with a ``.csv`` or ``.csv.gz`` file anywhere under the area."""
    names = sorted({t for f in _files(spark, _folder(root, area), True) if (t := _table_of(f))})
    return spark.createDataFrame([(n,) for n in names], "table_name string")


def resolve(spark: SparkSession, root: str, table: str, area: str | None) -> list[str]:
    """Files of a table: directly in the area folder, else anywhere below it. Missing is an error."""
    folder = _folder(root, area)
    for recursive in (False, True):
        found = [f for f in _files(spark, folder, recursive) if _table_of(f) == table]
        if found:
            return found
    raise FileNotFoundError(f"no {table}.csv or {table}.csv.gz under {folder}")


def equals_all(values: Mapping[str, object]) -> Column:
    """AND of equalities; an empty mapping keeps every row."""
    return reduce(and_, [F.col(k) == F.lit(v) for k, v in values.items()], F.lit(True))


def shaped(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
    limit: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Filter, then project, then (only if asked) the first ``limit`` rows in an explicit order."""
    if where is not None:
        df = df.where(where)
    if limit is not None:
        df = df.orderBy(*(order or df.columns)).limit(limit)
    return df.select(*columns) if columns else df


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    area: str | None = None,
    schema: str | T.StructType | None = None,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
    limit: int | None = None,
    order: Sequence[str] = (),
    bad_rows: str = "drop",
) -> DataFrame:
    """A delimited table by name, with its declared schema.

    ``bad_rows``: ``drop`` skips rows that do not fit the schema, ``null`` keeps them with nulls,
    ``fail`` stops the job. The whole row decides, also when few columns are read.
    """
    modes = {"drop": "DROPMALFORMED", "null": "PERMISSIVE", "fail": "FAILFAST"}
    schema = schema or RAW[(str(area).lower(), table)]
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", modes[bad_rows])
        .csv(resolve(spark, root, table, area))
    )
    if bad_rows != "null":
        df = _all_columns_read(df)
    return shaped(df, columns, where, limit, order)


def _all_columns_read(df: DataFrame) -> DataFrame:
    """Keeps column pruning from hiding a bad value in a column nobody asked for. The filter is always true."""
    nulls = reduce(add, [F.col(c).isNull().cast("int") for c in df.columns])
    return df.where(nulls >= 0)


def bad_rows(spark: SparkSession, files: Sequence[str], schema: str) -> DataFrame:
    """The raw lines that do not fit the schema (``line``), for a side table. Header lines are left out."""
    names = T._parse_datatype_string(schema).names
    lines = spark.read.text(list(files)).where(F.col("value") != ",".join(names))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select("value", F.from_csv("value", f"{schema}, _bad string", options).alias("r"))
    return parsed.where(F.col("r._bad").isNotNull()).select(F.col("value").alias("line"))


def count_rows(df: DataFrame, where: Column | None = None) -> DataFrame:
    return shaped(df, where=where).agg(F.count(F.lit(1)).alias("n_rows"))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return shaped(spark.read.parquet(path), columns)
