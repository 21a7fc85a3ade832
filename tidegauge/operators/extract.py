"""Readings of interest inside padded stays, as one tall series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.parsing import coalesced_value, normalized
from tidegauge.operators.events import padded_stay

DAY_US = 86_400_000_000


def _day(t: Column) -> Column:
    return F.floor(F.unix_micros(t) / DAY_US).cast("long")


def within_stay(
    readings: DataFrame, stays: DataFrame, key: str, ts: str, start: str = "win_start", end: str = "win_end"
) -> DataFrame:
    """Readings joined to the stays of the same key whose closed window holds them.

    The window is spread over the days it touches and days are part of the join key: a key with very many
    readings is split by day, and a reading meets only the stays that can hold it. ``readings`` columns
    come first; a column on both sides is taken from the stay, else from the reading.
    """
    shared = [c for c in stays.columns if c in readings.columns and c != key]
    days = F.sequence(_day(F.col(start)), _day(F.col(end)))
    by_day = (
        stays.where(F.col(start) <= F.col(end))
        .withColumn("__day", F.explode(days))
        .withColumnsRenamed({c: f"__s_{c}" for c in shared})
    )
    at_day = readings.where(F.col(ts).isNotNull()).withColumn("__day", _day(F.col(ts)))
    lo = f"__s_{start}" if start in shared else start
    hi = f"__s_{end}" if end in shared else end
    joined = at_day.join(by_day, [key, "__day"]).where(F.col(ts).between(F.col(lo), F.col(hi)))
    for c in shared:
        joined = joined.withColumn(c, F.coalesce(F.col(f"__s_{c}"), F.col(c))).drop(f"__s_{c}")
    return joined.drop("__day")


def name_items(readings: DataFrame, variables: DataFrame, item: str = "itemid") -> DataFrame:
    """Keep listed items, with their variable (one per item)."""
    return readings.join(variables.select(item, "variable"), item)


def vitals(chart: DataFrame, cohort: DataFrame, variables: DataFrame, pad_hours: float = 6.0) -> DataFrame:
    """Bedside series keyed by stay; the value column is chosen once for the table."""
    stays = padded_stay(cohort, "icu_in", "icu_out", pad_hours).select("stay_id", "hadm_id", "win_start", "win_end")
    readings = name_items(normalized(chart, ["stay_id", "hadm_id"]), variables)
    return within_stay(readings, stays, "stay_id", "charttime").select("stay_id", "hadm_id", "charttime", "variable", "value")


def labs(tests: DataFrame, cohort: DataFrame, variables: DataFrame, pad_hours: float = 6.0) -> DataFrame:
    """Laboratory series: admissions are re-keyed to their stays; the value is resolved row by row."""
    stays = padded_stay(cohort, "icu_in", "icu_out", pad_hours).select("stay_id", "hadm_id", "win_start", "win_end")
    readings = tests.select("hadm_id", "charttime", "itemid", coalesced_value("valuenum", "value").alias("value"))
    readings = name_items(readings.na.drop(subset=["hadm_id", "charttime", "itemid", "value"]), variables)
    return within_stay(readings, stays, "hadm_id", "charttime").select("stay_id", "hadm_id", "charttime", "variable", "value")


def series(*parts: DataFrame) -> DataFrame:
    """Union of series by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
