"""Profiles of tables: counts, missingness, distributions, usable columns, filter funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.ordered import quantiles_wide

# Columns that identify or label a row and are never features.
NOT_FEATURES = ("stay_id", "hadm_id", "index_time", "first_event_time", "label")
# The quantiles of a description.
DESCRIBE = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def numeric_columns(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def basic_counts(df: DataFrame, entity: str, label: str, ts: str) -> DataFrame:
    """Rows, distinct entities, positive rate and time range, one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(entity).alias("n_entities"),
        F.avg(label).alias("positive_rate"),
        F.min(ts).alias("time_min"),
        F.max(ts).alias("time_max"),
    )


def label_stats(labels: DataFrame, by: str = "horizon_hours", label: str = "label") -> DataFrame:
    """Count, positives and rate in percent (two digits) per horizon."""
    return labels.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("long")).alias("positives"),
        F.round(F.avg(label) * 100, 2).alias("rate_pct"),
    )


def entity_profile(df: DataFrame, entity: str, label: str, ts: str) -> DataFrame:
    """Entities, positive entities, windows per entity (median, p10, p90) and median time span in hours."""
    per = df.groupBy(entity).agg(
        F.max(label).alias("entity_label"),
        F.count(F.lit(1)).alias("n_windows"),
        ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 3.6e9).alias("span_hours"),
    )
    head = per.agg(F.count(F.lit(1)).alias("n_entities"), F.avg("entity_label").alias("positive_rate"))
    windows = quantiles_wide(per, "n_windows", {"windows_median": 0.5, "windows_p10": 0.1, "windows_p90": 0.9})
    span = quantiles_wide(per, "span_hours", {"span_hours_median": 0.5})
    scalars = [windows.select(c).scalar().alias(c) for c in windows.columns] + [span.select(c).scalar().alias(c) for c in span.columns]
    return head.select("*", *scalars)


def describe(df: DataFrame, value: str, by: Sequence[str] = (), std: str = "sample", named: Mapping[str, float] = DESCRIBE) -> DataFrame:
    """Count, mean, std, min, quantiles and max of one measure, per group if asked."""
    v = F.col(value).cast("double")
    spread = F.stddev_samp(v) if std == "sample" else F.stddev_pop(v)
    keys = list(by)
    base = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), spread.alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    q = quantiles_wide(df, value, named, keys)
    if keys:
        return base.join(q, keys, "left")
    return base.select("*", *[q.select(c).scalar().alias(c) for c in named])


def missingness(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> DataFrame:
    """(column, missing_rate) for every column, from one aggregation."""
    cols = [c for c in df.columns if c not in exclude]
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return rates.unpivot([], cols, "column", "missing_rate")


def numeric_profile(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> DataFrame:
    """``describe`` of every numeric column plus its missing rate, one row per column."""
    cols = numeric_columns(df, exclude)
    wide = df.select([F.col(c).cast("double").alias(c) for c in cols])
    # plain statistics of all columns are one aggregation; only the quantiles need a row for each value
    flat = wide.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("missing_rate"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
        ).alias(f"c{i}")
        for i, c in enumerate(cols)
    ])
    plain = flat.select(F.inline(F.array(*[f"c{i}" for i in range(len(cols))])))
    tall = wide.unpivot([], cols, "column", "value")
    return plain.join(quantiles_wide(tall, "value", DESCRIBE, ["column"]), "column", "left")


def value_counts(df: DataFrame, column: str, top: int | None = None, upper: bool = False) -> DataFrame:
    """Counts per value, nulls as their own bucket; ``top`` keeps the most frequent."""
    v = F.upper(F.col(column)) if upper else F.col(column)
    out = df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()).limit(top)


def column_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing_rate, std) for the candidate feature columns, from one aggregation.

    Columns are turned into rows first: two aggregates per column side by side make code too long to be compiled.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    tall = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "v")
    found = tall.groupBy("column").agg(F.avg(F.col("v").isNull().cast("double")).alias("missing_rate"), F.stddev_pop("v").alias("std"))
    return names.join(found, "column", "left")


def usable(quality: DataFrame, nan_threshold: float = 0.95, inclusive: bool = True) -> DataFrame:
    """Columns that are not too empty (``inclusive``: a rate at the threshold is too empty) and not constant."""
    rate = F.col("missing_rate")
    full = rate < nan_threshold if inclusive else rate <= nan_threshold
    return quality.where(full & F.col("std").isNotNull() & (F.col("std") != 0))


def select_columns(df: DataFrame, columns: Sequence[str] | None = None, nan_threshold: float = 0.95, inclusive: bool = True) -> list[str]:
    """Names of usable feature columns, in table order. Collects one row per column, no data."""
    good = {r["column"] for r in usable(column_quality(df, columns), nan_threshold, inclusive).collect()}
    cols = list(columns) if columns is not None else numeric_columns(df)
    return [c for c in cols if c in good]


def align_columns(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), fill: float | None = None) -> DataFrame:
    """Exactly the listed features in order: missing ones null (or ``fill``), others dropped."""
    have = set(df.columns)
    return df.select(*keys, *[F.col(f).cast("double").alias(f) if f in have else F.lit(fill).cast("double").alias(f) for f in features])


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """How many rows pass each filter alone and all filters up to it, to find where rows get lost."""
    aggs = [F.count(F.lit(1)).alias("n_all")]
    so_far: list[Column] = []
    for i, cond in enumerate(steps.values()):
        so_far.append(F.coalesce(cond, F.lit(False)))
        aggs += [F.count_if(so_far[-1]).alias(f"a_{i}"), F.count_if(reduce(and_, so_far)).alias(f"t_{i}")]
    flat = df.agg(*aggs)
    rows = [F.struct(F.lit(0).alias("step"), F.lit("all").alias("filter"), F.col("n_all").alias("n_alone"), F.col("n_all").alias("n_together"))]
    rows += [
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("filter"), F.col(f"a_{i}").alias("n_alone"), F.col(f"t_{i}").alias("n_together"))
        for i, name in enumerate(steps)
    ]
    return flat.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def hash_sample(df: DataFrame, n: int, key: Column) -> DataFrame:
    """``n`` rows in a fixed pseudo-random order; the same rows on every run."""
    return df.withColumn("__h", key).orderBy("__h").limit(n).drop("__h")
