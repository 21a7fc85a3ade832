"""Alerts from scored windows: batch table, daily cap, refractory suppression, weekly monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.ordered import head, previous_value, running_sums
from tidegauge.functions.spread import spread_join
from tidegauge.operators.evaluate import confusion, entity_alerts, prf, rank_metrics
from tidegauge.operators.leadtime import keep, lead_times, stats
from tidegauge.session import materialize

# Fixed value: release default.
REFRACTORY_HOURS = 24
# Hits of an unbroken piece that one row may hold; longer pieces go the other way.
SHORT_PIECE = 2_000


def batch(scored: DataFrame, thr: float, daily_cap: int | None = None, entity: str = "stay_id", ts: str = "index_time") -> DataFrame:
    """One row per entity: max_prob, first_alert_time, stay_pred. A cap, if given, keeps the earliest alerts per day."""
    stays = entity_alerts(scored, thr, entity, ts, label=None)
    return stays if daily_cap is None else daily_capped(stays, daily_cap, entity)


def daily_capped(stays: DataFrame, cap: int, entity: str = "stay_id", alert: str = "first_alert_time") -> DataFrame:
    """The first ``cap`` alerts of each calendar day; entities that never alert are dropped."""
    dated = stays.where(F.col(alert).isNotNull()).withColumns(
        {"__date": F.to_date(alert), "__minute": F.floor(F.unix_micros(alert) / 60_000_000).cast("long")}
    )
    order = [F.col(alert), F.col(entity)]
    return head(dated, ["__date"], order, cap, ["__minute"]).drop("__date", "__minute")


def suppress(
    scored: DataFrame, thr: float, refractory_h: float = REFRACTORY_HOURS, entity: str = "stay_id", ts: str = "index_time", prob: str = "prob", short: int = SHORT_PIECE
) -> DataFrame:
    """Alerts left when each one silences its entity for ``refractory_h`` hours; (entity, alert_time).

    The choice is sequential, but a hit that comes at least that long after the hit before it is always kept. So each
    entity is cut at such gaps. A piece of at most ``short`` hits is folded in one row; the hits of longer pieces point
    to their successors and are chased by pointer doubling, so that no task needs a whole piece. Hits of the same time
    are merged first.
    """
    wait = int(refractory_h * 3_600_000_000)
    hits = scored.where(F.col(prob) >= F.lit(float(thr))).select(F.col(entity), F.unix_micros(F.col(ts)).alias("__t")).distinct()
    celled = hits.withColumn("__cell", F.floor(F.col("__t") / max(wait, 3_600_000_000)).cast("long"))
    lagged = previous_value(celled, [entity], ["__cell"], F.col("__t"), {"__prev": "__t"})
    free = lagged.withColumn("__free", F.when(F.col("__prev").isNull() | (F.col("__t") - F.col("__prev") >= wait), 1).otherwise(0).cast("long"))
    numbered = running_sums(free, [entity], ["__cell"], [F.col("__t")], {"__piece": "__free"})
    pieces = materialize(numbered.select(entity, "__piece", "__t"), "pieces")
    keys = [entity, "__piece"]
    long = materialize(pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__t").alias("__t")).where(F.col("n") > short), "long-pieces")
    if long.isEmpty():
        kept = _folded(pieces, keys, wait)
    else:
        rest = spread_join(pieces, long.select(*keys), keys, "left_anti")
        kept = _folded(rest, keys, wait).unionByName(_chased(spread_join(pieces, long.select(*keys), keys, "left_semi"), long, entity, wait))
    return kept.select(entity, F.timestamp_micros("__t").alias("alert_time"))


def _folded(pieces: DataFrame, keys: list[str], wait: int) -> DataFrame:
    """Kept hits of short pieces, by one pass over the sorted times of each."""
    times = pieces.groupBy(*keys).agg(F.sort_array(F.collect_list("__t")).alias("ts"))
    start = F.struct(F.lit(None).cast("long").alias("until"), F.array().cast("array<bigint>").alias("kept"))
    taken = lambda acc, t: F.struct((t + F.lit(wait)).alias("until"), F.concat(acc["kept"], F.array(t)).alias("kept"))
    step = lambda acc, t: F.when(acc["until"].isNull() | (t >= acc["until"]), taken(acc, t)).otherwise(acc)
    return times.select(keys[0], F.explode(F.aggregate("ts", start, step)["kept"]).alias("__t"))


def successors(hits: DataFrame, entity: str, wait: int) -> DataFrame:
    """(entity, __t, __next): for each hit the first one of its entity at least ``wait`` later; hits without one are left out.

    Hits and the times asked for are put into cells of a sixteenth of the silence. The answer is the first hit from that
    time on in its cell or else the first hit of the next cell that has any, which the table of cells tells.
    """
    cell = lambda t: F.floor(t / F.lit(max(1, wait // 16))).cast("long")
    t = F.col("__t")
    asked = hits.select(entity, cell(t + wait).alias("cell"), (t + wait).alias("at"), t.alias("of"), F.lit(None).cast("long").alias("hit"))
    rows = asked.unionByName(hits.select(entity, cell(t).alias("cell"), t.alias("at"), F.lit(None).cast("long").alias("of"), t.alias("hit")))
    inside = Window.partitionBy(entity, "cell").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    here = rows.withColumn("here", F.min("hit").over(inside)).where("of is not null")
    cells = rows.groupBy(entity, "cell").agg(F.min("hit").alias("first"))
    later = Window.partitionBy(entity).orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    cells = cells.select(entity, "cell", F.min("first").over(later).alias("later"))
    found = here.join(cells, [entity, "cell"]).withColumn("__next", F.coalesce("here", "later"))
    return found.where("__next is not null").select(entity, F.col("of").alias("__t"), "__next")


def _chased(hits: DataFrame, long: DataFrame, entity: str, wait: int) -> DataFrame:
    """What the first hits of the pieces reach by their successors. Each round doubles the steps that are known.

    After round k the kept hits are those within 2^k steps and a pointer leads 2^k steps on, so rounds grow with the
    logarithm of the alerts in a piece. Joins are on (entity, time); a pointer never leads into a later piece that has
    not its own first hit, and what two pieces reach is merged.
    """
    jump = materialize(successors(hits, entity, wait), "successors")
    moved = long.select(entity, "__t")
    kept = moved
    while True:
        moved = materialize(kept.join(jump, [entity, "__t"]).select(entity, F.col("__next").alias("__t")), "reached")
        if moved.isEmpty():
            return kept.distinct()
        kept = materialize(kept.unionByName(moved).distinct(), "kept")
        onward = jump.select(entity, F.col("__t").alias("__next"), F.col("__next").alias("__far"))
        jump = materialize(jump.join(onward, [entity, "__next"]).select(entity, "__t", F.col("__far").alias("__next")), "successors")


def weekly(
    scored: DataFrame, thr: float, entity: str = "stay_id", ts: str = "index_time", event: str = "first_event_time", events: DataFrame | None = None
) -> DataFrame:
    """Per calendar week: window AUROC and AP (null with one class), entity counts and rates, lead-time stats."""
    weeks = scored.withColumn("week", F.date_trunc("week", ts))
    by = ["week"]
    windows = rank_metrics(weeks, by=by).select("week", "auroc", "ap")
    stays = lead_times(weeks, thr, entity, ts, event, positives=False, by=by, events=events)
    counts = prf(confusion(stays, thr, "stay_label", "max_prob", by))
    leads = keep(stays, "nonnegative")
    lead = stats(leads, by).select("week", F.col("n").alias("lead_n"), F.col("mean").alias("lead_mean"), F.col("p50").alias("lead_p50"))
    return counts.join(windows, by, "left").join(lead, by, "left").fillna(0, ["lead_n"])


def entity_detail(scored: DataFrame, thr: float, entity: str = "stay_id", ts: str = "index_time") -> tuple[DataFrame, DataFrame]:
    """Entity rows and, separately, their metrics at the threshold."""
    stays = entity_alerts(scored, thr, entity, ts)
    return stays, prf(confusion(stays, thr, "stay_label", "max_prob"))

