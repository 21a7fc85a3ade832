"""Registry of queries on the given tables and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import pin_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL check where SQL can say it."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return tidy(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(c: Column) -> Column:
    """Half away from zero at the sixth digit by plain arithmetic, which is far cheaper than decimal rounding."""
    scale = float(10**DIGITS)
    fast = F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale
    return F.when(F.abs(c) < 1e8, fast).otherwise(F.round(c, DIGITS)) + F.lit(0.0)


def tidy(df: DataFrame) -> DataFrame:
    """Result form: doubles to six digits, integers as bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = rounded(c.cast("double"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sql(ctes: Sequence[str], body: str, doubles: Sequence[str] = (), ints: Sequence[str] = ()) -> str:
    """A check query: shared table expressions, a body, and the same result form as ``tidy``."""
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    swaps = [f"round(CAST({d} AS DOUBLE), {DIGITS}) + 0.0 AS {d}" for d in doubles] + [f"CAST({i} AS BIGINT) AS {i}" for i in ints]
    shaped = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
    return f"{head}SELECT {shaped} FROM ({body}) AS result"
