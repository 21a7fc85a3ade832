"""Hourly prediction grids and forward-looking labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.timefn import ceil_hour, floor_hour, plus_hours


def hourly(
    stays: DataFrame,
    start: str = "icu_in",
    end: str = "icu_out",
    start_after_h: int = 6,
    event: str | None = None,
    mode: str = "prune",
    strict: bool = False,
) -> DataFrame:
    """One row per stay and full hour, as ``index_time``; all columns of ``stays`` are kept.

    ``prune``: hours from ceil(start + n) up to but not including floor(end), and before the event.
    ``cap``: hours from ceil(start + n) up to and including the cap, which is the event if it lies inside
    [start + n, end), else the end; an earlier event leaves the full grid.
    ``strict`` raises on stays that end before they start; otherwise they give no rows.
    """
    one_hour = F.expr("INTERVAL 1 HOUR")
    if mode not in ("prune", "cap"):
        raise ValueError(f"unknown mode {mode!r}")
    if strict:
        ok = F.when(F.col(end) <= F.col(start), F.raise_error(F.lit("stay ends before it starts"))).otherwise(True)
        stays = stays.where(ok)
    opened = plus_hours(start, start_after_h)
    first = ceil_hour(opened)
    if mode == "prune":
        last = floor_hour(end) - one_hour
    else:
        cap = F.col(end)
        if event:
            inside = (F.col(event) >= opened) & (F.col(event) < F.col(end))
            cap = F.when(inside, F.col(event)).otherwise(cap)
        last = F.when(cap > opened, first + F.make_dt_interval(hours=F.floor((F.unix_micros(cap) - F.unix_micros(first)) / 3_600_000_000).cast("int")))
    bounded = (
        stays.where(F.col(end) > F.col(start))
        .withColumn("__first", first)
        .withColumn("__last", last)
        .where(F.col("__first") <= F.col("__last"))
    )
    grid = bounded.withColumn("index_time", F.explode(F.sequence("__first", "__last", one_hour))).drop("__first", "__last")
    if event and mode == "prune":
        grid = prune(grid, event)
    return grid


def prune(grid: DataFrame, event: str, exclude_at_event: bool = True) -> DataFrame:
    """Drop grid points at or after the event (or only after it)."""
    ahead = F.col("index_time") < F.col(event) if exclude_at_event else F.col("index_time") <= F.col(event)
    return grid.where(F.col(event).isNull() | ahead)


def forward_label(event: Column | str, t: Column | str, horizon_h: Column | int) -> Column:
    """1 if the event lies in (t, t + horizon], else 0; no event gives 0."""
    ev = F.col(event) if isinstance(event, str) else event
    now = F.col(t) if isinstance(t, str) else t
    return F.coalesce(((ev > now) & (ev <= plus_hours(now, horizon_h))).cast("int"), F.lit(0))


def label(grid: DataFrame, event: str, horizons: Sequence[int]) -> DataFrame:
    """Every grid row once per horizon, with ``horizon_hours`` and ``label``. One pass, no join."""
    bad = [h for h in horizons if int(h) <= 0]
    if bad or not horizons:
        raise ValueError(f"horizons must be positive, got {list(horizons)}")
    out = grid.withColumn("horizon_hours", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    return out.withColumn("label", forward_label(event, "index_time", F.col("horizon_hours")))


def label_windows(grid: DataFrame, horizon_h: int) -> DataFrame:
    """The window (t, t + horizon] of each grid point."""
    return grid.withColumns({"window_start": F.col("index_time"), "window_end": plus_hours("index_time", horizon_h)})


def leak_check(df: DataFrame, feature_time: str, cutoff: str) -> DataFrame:
    """One row: does any feature time lie after its cutoff, and how many do."""
    late = F.count_if(F.col(feature_time) > F.col(cutoff))
    return df.agg((late == 0).alias("ok"), late.alias("n_violations"))


def align_nearest(
    points: DataFrame, grid: DataFrame, entity: str, ts: str, grid_ts: str, tol_minutes: float = 5.0
) -> DataFrame:
    """The nearest grid time of the same entity within a tolerance, as ``aligned``; ties take the later one.

    Only grid points within the tolerance matter, so time is cut into cells and each grid point is also
    placed in a neighbour cell it can reach. Inside a cell one running "last seen" in each direction finds
    both neighbours, so no pairs are built and a busy entity is spread over its cells.
    """
    tol = int(tol_minutes * 60_000_000)
    cell = max(3_600_000_000, 12 * tol)
    t = F.unix_micros(F.col(ts))
    g = F.unix_micros(F.col(grid_ts))
    reach = F.array_distinct(F.array(F.floor((g - tol) / cell), F.floor(g / cell), F.floor((g + tol) / cell)))
    cols = points.columns
    queries = points.select(
        F.col(entity), F.floor(t / cell).alias("__cell"), t.alias("__t"), F.lit(None).cast("long").alias("__g"),
        F.struct(*cols).alias("__row"),
    )
    marks = (
        grid.where(F.col(grid_ts).isNotNull())
        .select(entity, g.alias("__t"), F.explode(reach).alias("__cell"))
        .distinct()
        .select(entity, "__cell", "__t", F.col("__t").alias("__g"), F.lit(None).cast(queries.schema["__row"].dataType).alias("__row"))
    )
    both = queries.unionByName(marks)
    cells = Window.partitionBy(entity, "__cell")
    # Grid rows sort before queries of the same time, so an exact hit is seen from both sides.
    query_last = F.col("__row").isNotNull()
    past = cells.orderBy(F.col("__t"), query_last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = cells.orderBy(F.col("__t").desc(), query_last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__before", F.last("__g", True).over(past)).withColumn("__after", F.last("__g", True).over(future))
    back, ahead = F.col("__t") - F.col("__before"), F.col("__after") - F.col("__t")
    later = F.col("__before").isNull() | (ahead <= back)
    best = F.when(F.col("__after").isNotNull() & later, F.col("__after")).otherwise(F.col("__before"))
    return (
        seen.where(F.col("__row").isNotNull())
        .withColumn("__best", best)
        .select(
            *[F.col(f"__row.{c}").alias(c) for c in cols],
            F.when(F.abs(F.col("__best") - F.col("__t")) <= tol, F.timestamp_micros("__best")).alias("aligned"),
        )
    )
