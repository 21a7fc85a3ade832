"""First events per entity, and shaping of raw triggers into events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.ordered import previous_value, running_sums
from tidegauge.functions.spread import spread_join
from tidegauge.functions.timefn import hours_between, plus_hours

MINUTE_US = 60_000_000
# Busy entities are cut into cells of this length wherever rows must be put in time order.
CELL_HOURS = 24


def positive_dose(rate: str = "rate", amount: str = "amount", start: str = "starttime") -> Column:
    """A running drug: a positive rate or amount, and a known start."""
    return F.col(start).isNotNull() & ((F.coalesce(F.col(rate), F.lit(0.0)) > 0) | (F.coalesce(F.col(amount), F.lit(0.0)) > 0))


def tag_items(events: DataFrame, dictionary: DataFrame, item: str = "itemid") -> DataFrame:
    """Keep events whose item is in the dictionary, with its category (an item may have several)."""
    return events.join(dictionary.select(item, "category").distinct(), item)


def members(events: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Events of listed entities only. A busy entity's events are dealt to several tasks."""
    return spread_join(events, entities.select(entity).distinct(), [entity], "left_semi")


def since(events: DataFrame, entities: DataFrame, entity: str, ts: str, start: str, out: str = "hours") -> DataFrame:
    """Events with the hours from their entity's ``start``; entities without a row there are left out."""
    timed = spread_join(events, entities.select(entity, start), [entity])
    return timed.withColumn(out, hours_between(ts, start)).drop(start)


def first_events(
    events: DataFrame, entity: str, ts: str, conditions: Mapping[str, Column], total: str = "first_event_time"
) -> DataFrame:
    """Earliest time per entity for each named condition, and the earliest of them all.

    All conditions are conditional minima of one aggregation over one scan.
    """
    out = events.groupBy(entity).agg(*[F.min(F.when(cond, F.col(ts))).alias(name) for name, cond in conditions.items()])
    return out.withColumn(total, earliest(list(conditions)))


def earliest(columns: Sequence[str]) -> Column:
    """Row-wise minimum that ignores nulls."""
    return F.least(*columns) if len(columns) > 1 else F.col(columns[0])


def attach(entities: DataFrame, firsts: DataFrame, entity: str) -> DataFrame:
    """All entities, with their first events where there are any. Both sides have one row per entity."""
    return entities.join(firsts, entity, "left")


def detect(
    cohort: DataFrame, inputs: DataFrame, procedures: DataFrame, dictionary: DataFrame, entity: str = "stay_id"
) -> DataFrame:
    """First vasopressor, ventilation and renal-therapy time per cohort entity, and the earliest of them.

    Minima are combined before the shuffle, so each entity sends a row per task at most and the cohort is
    joined to one row per entity.
    """
    drug = inputs.where(positive_dose()).select(entity, "itemid", "starttime").withColumn("source", F.lit("input"))
    done = procedures.where(F.col("starttime").isNotNull()).select(entity, "itemid", "starttime").withColumn("source", F.lit("procedure"))
    tagged = tag_items(drug.unionByName(done), dictionary)
    firsts = first_events(
        tagged,
        entity,
        "starttime",
        {
            "vaso_time": (F.col("source") == "input") & (F.col("category") == "vasopressors"),
            "imv_time": (F.col("source") == "procedure") & (F.col("category") == "imv"),
            "crrt_time": (F.col("source") == "procedure") & (F.col("category") == "crrt"),
        },
    )
    return attach(cohort.select(entity), firsts, entity)


def with_cell(df: DataFrame, ts: str, hours: int = CELL_HOURS, name: str = "__cell") -> DataFrame:
    return df.withColumn(name, F.floor(F.unix_micros(F.col(ts)) / (hours * 3_600_000_000)).cast("long"))


def debounce(
    triggers: DataFrame, keys: Sequence[str], ts: str, gap_minutes: float, flags: Mapping[str, Column] | None = None
) -> DataFrame:
    """Merge triggers of the same keys that follow one another within the gap into one burst.

    One row per burst: keys, ``burst_start``, ``burst_end``, ``n_triggers``; ``flags`` adds a true/false per
    burst for each condition that any of its triggers meets. Repeated times are merged first.
    """
    flags = dict(flags or {})
    merged = triggers.groupBy(*keys, ts).agg(
        F.count(F.lit(1)).alias("__n"), *[F.max(F.coalesce(c, F.lit(False))).alias(f"__f_{n}") for n, c in flags.items()]
    )
    celled = with_cell(merged, ts)
    lagged = previous_value(celled, keys, ["__cell"], F.col(ts), {"__prev": ts})
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.col("__prev"))
    opened = lagged.withColumn("__open", F.when(gap.isNull() | (gap > int(gap_minutes * MINUTE_US)), 1).otherwise(0).cast("long"))
    numbered = running_sums(opened, keys, ["__cell"], [F.col(ts)], {"__burst": "__open"})
    return (
        numbered.groupBy(*keys, "__burst")
        .agg(
            F.min(ts).alias("burst_start"),
            F.max(ts).alias("burst_end"),
            F.sum("__n").alias("n_triggers"),
            *[F.max(f"__f_{n}").alias(n) for n in flags],
        )
        .drop("__burst")
    )


def confirmed_starts(
    triggers: DataFrame,
    keys: Sequence[str],
    ts: str,
    gap_minutes: float,
    strong: Column,
    supportive: Column,
    require_supportive: bool = False,
) -> DataFrame:
    """Bursts with at least one strong signal and, if asked, one supportive signal."""
    bursts = debounce(triggers.where(strong | supportive), keys, ts, gap_minutes, {"strong": strong, "supportive": supportive})
    keep = F.col("strong") & F.col("supportive") if require_supportive else F.col("strong")
    return bursts.where(keep)


def rate_changes(
    rates: DataFrame,
    keys: Sequence[str],
    ts: str,
    rate: str,
    relative: float,
    absolute: Column | None = None,
    min_positive: Column | None = None,
) -> DataFrame:
    """Starts (0 or nothing -> positive) and upgrades (a large enough relative or absolute rise) of a rate.

    Rows of the same keys and time count once, at their highest rate.
    """
    floor = min_positive if min_positive is not None else F.lit(0.0)
    merged = rates.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.max(F.coalesce(F.col(rate), F.lit(0.0))).alias(rate))
    lagged = previous_value(with_cell(merged, ts), keys, ["__cell"], F.col(ts), {"previous_rate": rate})
    before = F.coalesce(F.col("previous_rate"), F.lit(0.0))
    started = (before <= floor) & (F.col(rate) > floor)
    rise = F.col(rate) - before
    risen = (before > floor) & ((rise >= F.lit(relative) * before) | (rise >= absolute if absolute is not None else F.lit(False)))
    kind = F.when(started, "start").when(risen, "upgrade")
    return lagged.drop("__cell").withColumn("change", kind).where(F.col("change").isNotNull())


def preferred_first(events: DataFrame, entity: str, ts: str, preferred: Column, out: str) -> DataFrame:
    """Earliest preferred-source event; only without any, the earliest other event."""
    return events.groupBy(entity).agg(
        F.coalesce(F.min(F.when(preferred, F.col(ts))), F.min(F.when(~F.coalesce(preferred, F.lit(False)), F.col(ts)))).alias(out)
    )


def padded_stay(stays: DataFrame, start: str, end: str, pad_hours: float) -> DataFrame:
    """The closed window [start - pad, end + pad] of each stay."""
    return stays.withColumns({"win_start": plus_hours(start, -pad_hours), "win_end": plus_hours(end, pad_hours)})


def last_known(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, value: str, out: str) -> DataFrame:
    """The last earlier non-null ``value`` of the same keys, however long ago.

    Inside a time cell it is a running ``last``; before the first value of a cell, the last value of the
    nearest earlier cell that has one.
    """
    celled = with_cell(df, ts)
    order = F.struct(ts, tiebreak)
    ends = celled.groupBy(*keys, "__cell").agg(F.max_by(value, F.when(F.col(value).isNotNull(), order)).alias("__end"))
    along = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__cell", F.last("__end", True).over(along).alias("__carry"))
    inside = Window.partitionBy(*keys, "__cell").orderBy(ts, tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    joined = celled.join(carried, [*keys, "__cell"])
    return joined.withColumn(out, F.coalesce(F.last(value, True).over(inside), F.col("__carry"))).drop("__cell", "__carry")
