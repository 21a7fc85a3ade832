"""Lead time: hours between the first alert and the event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.ordered import quantiles_wide
from tidegauge.functions.timefn import hours_between
from tidegauge.operators.evaluate import entity_alerts
from tidegauge.operators.quality import describe


def lead_times(
    df: DataFrame,
    thr: float,
    entity: str = "stay_id",
    ts: str = "index_time",
    event: str = "first_event_time",
    positives: bool = True,
    by: Sequence[str] = (),
    events: DataFrame | None = None,
) -> DataFrame:
    """Entity rows with ``lead_hours``; null without an alert or event, negative if the alert came late.

    Event times stand on the windows, or in ``events`` (one row per entity), which is joined after the
    windows are pooled. ``positives`` keeps entities with a positive label only.
    """
    if events is None:
        alerts = entity_alerts(df, thr, entity, ts, by=by, extra={event: F.max(event)})
    else:
        alerts = entity_alerts(df, thr, entity, ts, by=by).join(events.select(entity, event), entity, "left")
    out = alerts.withColumn("lead_hours", hours_between(event, "first_alert_time"))
    return out.where(F.col("stay_label") == 1) if positives else out


def keep(leads: DataFrame, rule: str = "any") -> DataFrame:
    """``positive``: lead above 0. ``nonnegative``: predicted entities with a lead of at least 0."""
    lead = F.col("lead_hours")
    if rule == "any":
        return leads.where(lead.isNotNull())
    if rule == "positive":
        return leads.where(lead > 0)
    if rule == "nonnegative":
        return leads.where((F.col("stay_pred") == 1) & (lead >= 0))
    raise ValueError(f"unknown rule {rule!r}")


def stats(leads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return describe(leads, "lead_hours", by)


def histogram(df: DataFrame, value: str, bins: int = 24, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n) over equal-width bins; without limits they span the data. The top edge is in the last bin."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo = F.lit(float(low)) if low is not None else span.select("lo").scalar()
    hi = F.lit(float(high)) if high is not None else span.select("hi").scalar()
    share = (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins
    b = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.least(F.floor(share), F.lit(bins - 1)))
    rows = df.where(F.col(value).isNotNull()).withColumns({"__lo": lo, "__hi": hi})
    rows = rows.where(F.col(value).between(F.col("__lo"), F.col("__hi")))
    return rows.groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box(df: DataFrame, value: str) -> DataFrame:
    """Median, quartiles, whiskers at the last values within 1.5 IQR, and the number of outliers; one row."""
    q = quantiles_wide(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumns({"low_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "high_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    v = F.col(value)
    marked = df.where(v.isNotNull()).withColumns({c: q.select(c).scalar() for c in ("q1", "median", "q3", "low_fence", "high_fence")})
    inside = v.between(F.col("low_fence"), F.col("high_fence"))
    return marked.agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
