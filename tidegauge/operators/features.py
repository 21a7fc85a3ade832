"""Trailing-window statistics of irregular series on a prediction grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidegauge.functions.timefn import ceil_hour, floor_hour, hour_number

# The statistics of a window.
STATS = ("last", "mean", "min", "max", "std", "count", "trend_last_mean")
EXTRA_STATS = ("median", "iqr", "slope", "delta_pct", "missing")


def bucket_hour(ts: Column | str, bucket: str = "floor") -> Column:
    """Hour a reading counts for. ``floor`` lets minutes of the index hour in; ``ceil`` never looks ahead."""
    if bucket not in ("floor", "ceil"):
        raise ValueError(f"unknown bucket {bucket!r}")
    return floor_hour(ts) if bucket == "floor" else ceil_hour(ts)


def resample(
    readings: DataFrame, keys: Sequence[str], ts: str, value: str, bucket: str = "floor", out: str = "mean"
) -> DataFrame:
    """Hourly means: one row per keys and hour (``hour``)."""
    hour = bucket_hour(ts, bucket).alias("hour")
    return readings.groupBy(*keys, hour).agg(F.avg(value).alias(out))


def pivot_hours(
    readings: DataFrame, entity: str, ts: str, variable: str, value: str, variables: Sequence[str], bucket: str = "floor"
) -> DataFrame:
    """Hourly means with one column per variable, in one aggregation over the raw readings."""
    return (
        readings.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(entity), bucket_hour(ts, bucket).alias("hour"))
        .agg(*[F.avg(F.when(F.col(variable) == v, F.col(value))).alias(v) for v in variables])
    )


def _frame_stats(v: str, w: int, frame: WindowSpec, hour: Column, any_col: str, stats: Sequence[str]) -> dict[str, Column]:
    x = F.col(f"__v_{v}")
    last = F.last(x, ignorenulls=True).over(frame)
    mean = F.avg(x).over(frame)
    some = F.col(any_col) > 0
    seen = F.col(f"__seen_{v}")
    have = F.count(x).over(frame)
    first = F.first(x, ignorenulls=True).over(frame)
    exprs = {
        "last": last,
        "mean": mean,
        "min": F.min(x).over(frame),
        "max": F.max(x).over(frame),
        "std": F.stddev_pop(x).over(frame),
        "count": F.when(some & seen, have.cast("double")),
        "trend_last_mean": last - mean,
        "median": F.percentile(x, F.lit(0.5)).over(frame),
        "iqr": F.percentile(x, F.lit(0.75)).over(frame) - F.percentile(x, F.lit(0.25)).over(frame),
        "slope": F.regr_slope(x, hour.cast("double")).over(frame),
        "delta_pct": F.when(first != 0, (last - first) / F.abs(first)),
        "missing": F.when(have > 0, 0.0).otherwise(1.0),
    }
    return {f"{v}__{w}h__{s}": exprs[s] for s in stats}


def window_stats(
    grid: DataFrame,
    readings: DataFrame,
    variables: Sequence[str],
    windows: Sequence[int] = (6, 24),
    stats: Sequence[str] = STATS,
    entity: str = "stay_id",
    index_time: str = "index_time",
    ts: str = "charttime",
    variable: str = "variable",
    value: str = "value",
    bucket: str = "floor",
) -> DataFrame:
    """One row per grid row with ``{variable}__{w}h__{stat}`` columns over the hours (t - w, t].

    Statistics are over hourly means. A variable the entity never has gives nulls throughout. A variable
    without data in the frame gives nulls and a count of 0, unless no variable has data there.

    Readings are first merged to one row per entity and hour, largely before the shuffle, so what an entity
    brings to its window is bounded by the hours of its history (8,784 rows a year) and not by its readings.
    Grid points and hourly rows then form one table; a range frame over the hour number sees for each grid
    point what a range join would. All variables and widths share one shuffle and one sort.
    """
    bad = [w for w in windows if int(w) <= 0]
    if bad or not windows:
        raise ValueError(f"windows must be positive, got {list(windows)}")

    hours = pivot_hours(readings, entity, ts, variable, value, variables, bucket)
    some = F.coalesce(*[F.when(F.col(v).isNotNull(), 1) for v in variables])
    left = hours.select(
        entity, hour_number("hour").alias("__h"), *[F.col(v).alias(f"__v_{v}") for v in variables], some.alias("__some")
    )
    kept = grid.columns
    points = grid.select(F.col(entity), hour_number(index_time).alias("__h"), F.struct(*kept).alias("__row"))
    rows = left.unionByName(points, allowMissingColumns=True)

    whole = Window.partitionBy(entity)
    along = whole.orderBy("__h")
    frames = {w: along.rangeBetween(-(int(w) - 1), 0) for w in windows}
    any_cols = {w: f"__any_{w}" for w in windows}
    first, last = (f(F.when(F.col("__row").isNotNull(), F.col("__h"))).over(whole) for f in (F.min, F.max))
    marks: dict[str, Column] = {"__from": first - (max(windows) - 1), "__to": last}
    if "count" in stats:
        marks.update({f"__seen_{v}": F.count(f"__v_{v}").over(whole) > 0 for v in variables})
    # Hours that no frame of the entity can reach are dropped before any frame is computed.
    rows = rows.withColumns(marks).where(F.col("__h").between(F.col("__from"), F.col("__to")))
    rows = rows.withColumns({any_cols[w]: F.count("__some").over(frames[w]) for w in windows})
    feats: dict[str, Column] = {}
    for w in windows:
        for v in variables:
            feats.update(_frame_stats(v, w, frames[w], F.col("__h"), any_cols[w], stats))
    out = rows.withColumns(feats).where(F.col("__row").isNotNull())
    return out.select(*[F.col(f"__row.{c}").alias(c) for c in kept], *feats)


def outer_fold(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Separately stored window tables side by side, keys of either kept."""
    return left.join(right, list(keys), "full")


def assemble(labels: DataFrame, features: DataFrame, keys: Sequence[str] = ("stay_id", "index_time"), horizon: int | None = None) -> DataFrame:
    """Labels with their features; rows without key or label are dropped."""
    if horizon is not None:
        labels = labels.where(F.col("horizon_hours") == horizon).drop("horizon_hours")
    return labels.join(features, list(keys), "left").na.drop(subset=[*keys, "label"])


def fullest(features: DataFrame, suffix: str = "__mean", n: int = 10) -> DataFrame:
    """The columns with the highest non-null rate among those with a suffix."""
    cols = [c for c in features.columns if c.endswith(suffix)]
    rates = features.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols])
    tall = rates.unpivot([], cols, "feature", "non_null_rate")
    return tall.orderBy(F.col("non_null_rate").desc(), "feature").limit(n)
