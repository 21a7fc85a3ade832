"""Queries over grids, labels, trailing-window features and event shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.ordered import hash60
from tidegauge.functions.timefn import floor_hour, plus_hours
from tidegauge.functions.vocab import UPGRADE_RELATIVE
from tidegauge.operators import dictionary, events, extract, features, grid, split
from tidegauge.plans import data as d
from tidegauge.plans.catalog import query, sql

# -- grid and labels --------------------------------------------------------------------------------------


@query("g1_hourly_grid", sql(d.TIMELINE[:5], "SELECT stay_id, index_time FROM fullgrid"))
def g1(spark, sf):
    return grid.hourly(d.stays(spark, sf), start_after_h=d.START_AFTER).select("stay_id", "index_time")


@query("g2_pruned_grid", sql(d.TIMELINE, "SELECT stay_id, index_time FROM grid"))
def g2(spark, sf):
    return d.grid_points(spark, sf).select("stay_id", "index_time")


CAPPED = (
    "capped AS (SELECT stay_id, unnest(generate_series(first_t, first_t + to_hours(CAST(floor(epoch(cap - first_t) / 3600) AS BIGINT)), INTERVAL 1 HOUR)) AS index_time, first_event_time "
    "FROM (SELECT *, CASE WHEN date_trunc('hour', opened) = opened THEN opened ELSE date_trunc('hour', opened) + INTERVAL 1 HOUR END AS first_t, "
    "CASE WHEN first_event_time >= opened AND first_event_time < icu_out THEN first_event_time ELSE icu_out END AS cap "
    f"FROM (SELECT s.stay_id, icu_out, first_event_time, icu_in + INTERVAL {d.START_AFTER} HOUR AS opened FROM stays s LEFT JOIN firsts f ON s.stay_id = f.stay_id) a) b "
    "WHERE cap > opened AND cap >= first_t)"
)


@query("g3_capped_grid", sql([*d.TIMELINE[:4], CAPPED], "SELECT stay_id, index_time, CASE WHEN first_event_time > index_time AND first_event_time <= index_time + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS label FROM capped", ints=["label"]))
def g3(spark, sf):
    """The grid that runs up to and including the event; early events keep the full grid with label 0."""
    g = d.grid_points(spark, sf, mode="cap")
    return g.select("stay_id", "index_time", grid.forward_label("first_event_time", "index_time", 24).alias("label"))


@query("g4_forward_label", sql([*d.TIMELINE, d.LABELS], "SELECT stay_id, index_time, label FROM labels_all WHERE horizon_hours = 24", ints=["label"]))
def g4(spark, sf):
    g = d.grid_points(spark, sf)
    return g.select("stay_id", "index_time", grid.forward_label("first_event_time", "index_time", 24).alias("label"))


@query("g5_labels_all_horizons", sql([*d.TIMELINE, d.LABELS], "SELECT stay_id, index_time, horizon_hours, label, first_event_time FROM labels_all", ints=["horizon_hours", "label"]))
def g5(spark, sf):
    return d.labels(spark, sf)


@query("g6_label_windows", sql(d.TIMELINE, "SELECT stay_id, index_time AS window_start, index_time + INTERVAL 24 HOUR AS window_end FROM grid"))
def g6(spark, sf):
    return grid.label_windows(d.grid_points(spark, sf), 24).select("stay_id", "window_start", "window_end")


@query("g7_leak_check", sql([d.SERIES], "SELECT count(*) FILTER (charttime > date_trunc('hour', charttime)) = 0 AS ok, count(*) FILTER (charttime > date_trunc('hour', charttime)) AS n_violations FROM series", ints=["n_violations"]))
def g7(spark, sf):
    """Readings booked on the hour they fall in lie after that hour's index time."""
    s = d.series(spark, sf).withColumn("cutoff", features.bucket_hour("charttime", "floor"))
    return grid.leak_check(s, "charttime", "cutoff")


def _newest_sql(hour: str) -> str:
    """For each grid row, the newest raw reading whose booked hour lies in its last six hours."""
    return (
        "newest AS (SELECT g.stay_id, g.index_time, max(s.charttime) AS newest FROM grid g JOIN "
        f"(SELECT stay_id, charttime, {hour} AS hour FROM extracted) s ON s.stay_id = g.stay_id AND s.hour > g.index_time - INTERVAL 6 HOUR AND s.hour <= g.index_time GROUP BY 1, 2)"
    )


LEAK = "SELECT count(*) FILTER (newest > index_time) = 0 AS ok, count(*) FILTER (newest > index_time) AS n_violations FROM newest"


def _frames(spark, sf, bucket):
    """The newest raw reading that the six-hour frame of each grid row takes in, by the frames of the features."""
    s = d.extracted(spark, sf).select("stay_id", "charttime", F.lit("newest").alias("variable"), F.unix_micros("charttime").cast("double").alias("value"))
    latest = s.groupBy("stay_id", features.bucket_hour("charttime", bucket).alias("hour")).agg(F.max("value").alias("value"))
    latest = latest.select("stay_id", F.col("hour").alias("charttime"), F.lit("newest").alias("variable"), "value")
    f = features.window_stats(d.grid_points(spark, sf).select("stay_id", "index_time"), latest, ["newest"], [6], ["max"])
    return f.where(F.col("newest__6h__max").isNotNull()).withColumn("newest", F.timestamp_micros(F.col("newest__6h__max").cast("long")))


@query("g7_frame_leak_floor", sql([*d.TIMELINE, d.EXTRACTED, _newest_sql("date_trunc('hour', charttime)")], LEAK, ints=["n_violations"]))
def g7_floor(spark, sf):
    """Frames of hours booked downwards take in minutes after their index time."""
    return grid.leak_check(_frames(spark, sf, "floor"), "newest", "index_time")


@query("g7_leak_check_ceil", sql([*d.TIMELINE, d.EXTRACTED, _newest_sql("CASE WHEN date_trunc('hour', charttime) = charttime THEN charttime ELSE date_trunc('hour', charttime) + INTERVAL 1 HOUR END")], LEAK, ints=["n_violations"]))
def g7_ceil(spark, sf):
    """Frames of hours booked upwards never do."""
    return grid.leak_check(_frames(spark, sf, "ceil"), "newest", "index_time")


# -- trailing windows ----------------------------------------------------------------------------------------

# Hourly means, the variables each stay has, and statistics per (stay, grid time, variable) by a plain range join.
HOURLY = "hourly AS (SELECT stay_id, variable, {hour} AS hour, avg(value) AS mean FROM extracted GROUP BY 1, 2, 3)"
FLOOR_HOUR = "date_trunc('hour', charttime)"
CEIL_HOUR = "CASE WHEN date_trunc('hour', charttime) = charttime THEN charttime ELSE date_trunc('hour', charttime) + INTERVAL 1 HOUR END"
SEEN = "seen AS (SELECT DISTINCT stay_id, variable FROM hourly)"


def tall_sql(w: int) -> str:
    """Window statistics in tall form for one width."""
    return (
        f"tall{w} AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY stay_id, index_time) > 0 THEN n END AS cnt, last - mean AS trend FROM ("
        "SELECT g.stay_id, g.index_time, s.variable, arg_max(h.mean, h.hour) AS last, avg(h.mean) AS mean, min(h.mean) AS min, max(h.mean) AS max, "
        "stddev_pop(h.mean) AS std, count(h.mean) AS n, median(h.mean) AS median, quantile_cont(h.mean, 0.75) - quantile_cont(h.mean, 0.25) AS iqr, "
        "regr_slope(h.mean, epoch(h.hour) / 3600.0) AS slope, arg_min(h.mean, h.hour) AS first "
        "FROM (SELECT DISTINCT stay_id, index_time FROM grid) g JOIN seen s ON g.stay_id = s.stay_id "
        f"LEFT JOIN hourly h ON h.stay_id = g.stay_id AND h.variable = s.variable AND h.hour > g.index_time - INTERVAL {w} HOUR AND h.hour <= g.index_time "
        "GROUP BY 1, 2, 3) q)"
    )


STAT_SQL = {"last": "last", "mean": "mean", "min": "min", "max": "max", "std": "std", "count": "cnt", "trend_last_mean": "trend",
            "median": "median", "iqr": "iqr", "slope": "slope", "delta_pct": "CASE WHEN first <> 0 THEN (last - first) / abs(first) END"}


def wide_sql(windows, stats, variables=tuple(d.VARIABLES)) -> tuple[str, list[str]]:
    """The tall tables pivoted to feature columns, one row per grid point."""
    names, cols = [], []
    for w in windows:
        for v in variables:
            for s in stats:
                names.append(f"{v}__{w}h__{s}")
                cols.append(f"max(CASE WHEN t{w}.variable = '{v}' THEN {_qualified(STAT_SQL[s], w)} END) AS {v}__{w}h__{s}")
    joins = f"LEFT JOIN tall{windows[0]} t{windows[0]} ON t{windows[0]}.stay_id = g.stay_id AND t{windows[0]}.index_time = g.index_time"
    for w in windows[1:]:
        joins += f" LEFT JOIN tall{w} t{w} ON t{w}.stay_id = g.stay_id AND t{w}.index_time = g.index_time AND t{w}.variable = t{windows[0]}.variable"
    return f"SELECT g.stay_id, g.index_time, {', '.join(cols)} FROM (SELECT DISTINCT stay_id, index_time FROM grid) g {joins} GROUP BY 1, 2", names


def _qualified(expr: str, w: int) -> str:
    for c in ("last", "mean", "min", "max", "std", "cnt", "trend", "median", "iqr", "slope"):
        if expr == c:
            return f"t{w}.{c}"
    return f"CASE WHEN t{w}.first <> 0 THEN (t{w}.last - t{w}.first) / abs(t{w}.first) END"


def window_ctes(windows, hour=FLOOR_HOUR):
    return [*d.TIMELINE, d.EXTRACTED, HOURLY.format(hour=hour), SEEN, *[tall_sql(w) for w in windows]]


_W1, _W1_NAMES = wide_sql(d.WINDOWS, features.STATS)


def _windows(spark, sf, **kw):
    g = d.grid_points(spark, sf).select("stay_id", "index_time")
    return features.window_stats(g, d.extracted(spark, sf), d.VARIABLES, **kw)


@query("w1_trailing_windows", sql(window_ctes(d.WINDOWS), _W1, _W1_NAMES))
def w1(spark, sf):
    """Seven statistics of every variable over the last 6 and 24 hours of each grid point."""
    return _windows(spark, sf, windows=d.WINDOWS)


_CEIL, _CEIL_NAMES = wide_sql([6], ["last", "count"])


@query("w1_trailing_windows_no_lookahead", sql(window_ctes([6], CEIL_HOUR), _CEIL, _CEIL_NAMES))
def w1_ceil(spark, sf):
    """Minutes after the index hour do not count for it."""
    return _windows(spark, sf, windows=[6], stats=["last", "count"], bucket="ceil")


@query("j8_trailing_count_join", sql(window_ctes([24]), "SELECT stay_id, index_time, CAST(sum(n) AS BIGINT) AS hours_with_data FROM tall24 GROUP BY 1, 2", ints=["hours_with_data"]))
def j8(spark, sf):
    """What each grid point sees of the last 24 hours; a union and a range frame instead of a range join."""
    f = _windows(spark, sf, windows=[24], stats=["count"])
    total = sum((F.coalesce(F.col(f"{v}__24h__count"), F.lit(0.0)) for v in d.VARIABLES[1:]), F.coalesce(F.col(f"{d.VARIABLES[0]}__24h__count"), F.lit(0.0)))
    seen = d.extracted(spark, sf).select("stay_id").distinct()
    return f.join(seen, "stay_id", "left_semi").select("stay_id", "index_time", total.cast("long").alias("hours_with_data"))


_J9 = "SELECT l.stay_id, l.index_time, l.first_event_time, l.label, f.* EXCLUDE (stay_id, index_time) FROM labels_all l LEFT JOIN ({}) f ON f.stay_id = l.stay_id AND f.index_time = l.index_time WHERE l.horizon_hours = 24"
_J9_FEATURES, _J9_NAMES = wide_sql([24], ["mean", "count"])


@query("j9_labels_with_features", sql([*window_ctes([24]), d.LABELS], _J9.format(_J9_FEATURES), _J9_NAMES, ["label"]))
def j9(spark, sf):
    """Labels of one horizon joined to stored features on (stay, time)."""
    return features.assemble(d.labels(spark, sf), _windows(spark, sf, windows=[24], stats=["mean", "count"]), horizon=24)


_J10A, _ = wide_sql([6], ["mean"])
_J10B, _ = wide_sql([24], ["mean"])


@query(
    "j10_outer_fold",
    sql(window_ctes([6, 24]),
        "SELECT coalesce(a.stay_id, b.stay_id) AS stay_id, coalesce(a.index_time, b.index_time) AS index_time, a.view__6h__mean, b.view__24h__mean "
        f"FROM (SELECT * FROM ({_J10A}) x WHERE view__6h__mean IS NOT NULL) a FULL JOIN (SELECT * FROM ({_J10B}) y WHERE view__24h__mean < 50) b ON a.stay_id = b.stay_id AND a.index_time = b.index_time",
        ["view__6h__mean", "view__24h__mean"]),
)
def j10(spark, sf):
    """Two separately stored window tables side by side."""
    a = _windows(spark, sf, windows=[6], stats=["mean"]).where(F.col("view__6h__mean").isNotNull()).select("stay_id", "index_time", "view__6h__mean")
    b = _windows(spark, sf, windows=[24], stats=["mean"]).where(F.col("view__24h__mean") < 50).select("stay_id", "index_time", "view__24h__mean")
    return features.outer_fold(a, b, ["stay_id", "index_time"])


@query(
    "j13_nearest_grid_point",
    sql([*d.TIMELINE],
        "SELECT s.event_id, CASE WHEN near IS NOT NULL AND abs(epoch_us(near) - epoch_us(ts)) <= 300000000 THEN near END AS aligned FROM ("
        "SELECT e.event_id, e.ts, arg_min(g.index_time, abs(epoch_us(g.index_time) - epoch_us(e.ts)) * 2 + CASE WHEN g.index_time >= e.ts THEN 0 ELSE 1 END) AS near "
        "FROM events e LEFT JOIN grid g ON g.stay_id = e.user_id AND g.index_time BETWEEN e.ts - INTERVAL 5 MINUTE AND e.ts + INTERVAL 5 MINUTE GROUP BY 1, 2) s"),
)
def j13(spark, sf):
    """Each event's nearest grid point of its stay within five minutes, either side."""
    e = d.table(spark, sf, "events").select("event_id", F.col("user_id").alias("stay_id"), "ts")
    return grid.align_nearest(e, d.grid_points(spark, sf), "stay_id", "ts", "index_time", 5).select("event_id", "aligned")


# -- flagship ---------------------------------------------------------------------------------------------------

_FLAG = "SELECT l.stay_id, l.index_time, l.first_event_time, l.horizon_hours, l.label, f.* EXCLUDE (stay_id, index_time) FROM labels_all l LEFT JOIN ({}) f ON f.stay_id = l.stay_id AND f.index_time = l.index_time"


@query("flagship_trainset", sql([*window_ctes(d.WINDOWS), d.LABELS], _FLAG.format(_W1), _W1_NAMES, ["horizon_hours", "label"]))
def flagship(spark, sf):
    """Raw events to labelled features: stays, first events, grid, trailing windows, labels for all horizons.

    Labels depend on the grid row alone, so they are added to the feature rows and nothing is joined back.
    """
    f = features.window_stats(d.grid_points(spark, sf), d.extracted(spark, sf), d.VARIABLES, d.WINDOWS)
    return grid.label(f, "first_event_time", d.HORIZONS)


# Dictionary words to categories, and the items that are readings; the words are those of the given item names.
EVENT_WORDS = {"vasopressors": {"plate": [r"\bplate\b"], "bolt": [r"\bbolt\b"]}, "imv": {"rod": [r"\brod\b"]}, "crrt": {"ring": [r"\bring\b"]}}
READING_WORDS = {"red": ["red"], "blue": ["blue"], "green": ["green"], "large": ["large"], "small": ["small"]}


def _words_sql(bank):
    return ", ".join(f"('{name}', {i}, '{'|'.join(words)}')" for i, (name, words) in enumerate(bank.items()))


_RAW = [
    "itemdict AS (SELECT DISTINCT category, name, p_partkey AS itemid FROM (SELECT p_partkey, concat_ws(' | ', p_name, p_brand, p_type) AS t FROM part) p, (VALUES "
    + ", ".join(f"('{c}', '{n}', '{w[0]}')" for c, bank in EVENT_WORDS.items() for n, w in bank.items())
    + ") b(category, name, pattern) WHERE regexp_matches(t, '(?i)' || pattern))",
    f"vars AS (SELECT p_partkey AS itemid, arg_max(name, o) AS variable FROM part, (VALUES {_words_sql(READING_WORDS)}) b(name, o, pattern) WHERE regexp_matches(lower(trim(p_name)), pattern) GROUP BY 1)",
    "raw AS (SELECT user_id AS stay_id, ts, CAST(props ->> '$.k' AS BIGINT) AS itemid, event_type, value FROM events)",
    d.STAYS,
    "tagged AS (SELECT stay_id, ts, category, event_type FROM raw JOIN (SELECT DISTINCT itemid, category FROM itemdict) c USING (itemid) WHERE (event_type IN ('error', 'purchase') AND value > 60) OR event_type = 'signup')",
    "tagged_firsts AS (SELECT stay_id, min(ts) FILTER (event_type <> 'signup' AND category = 'vasopressors') AS vaso_time, min(ts) FILTER (event_type = 'signup' AND category = 'imv') AS imv_time, "
    "min(ts) FILTER (event_type = 'signup' AND category = 'crrt') AS crrt_time FROM tagged GROUP BY 1)",
    "firsts AS (SELECT *, least(vaso_time, imv_time, crrt_time) AS first_event_time FROM tagged_firsts)",
    d.FULLGRID,
    d.GRID,
    "extracted AS (SELECT r.stay_id, r.ts AS charttime, variable, value FROM raw r JOIN vars USING (itemid) JOIN stays t ON r.stay_id = t.stay_id "
    f"AND r.ts BETWEEN t.icu_in - INTERVAL {d.PAD_HOURS} HOUR AND t.icu_out + INTERVAL {d.PAD_HOURS} HOUR WHERE event_type IN ('click', 'view') AND value IS NOT NULL)",
    HOURLY.format(hour=FLOOR_HOUR),
    SEEN,
    *[tall_sql(w) for w in d.WINDOWS],
    d.LABELS,
]
_RAW_WIDE, _RAW_NAMES = wide_sql(d.WINDOWS, features.STATS, tuple(READING_WORDS))


@query("raw_to_trainset", sql(_RAW, _FLAG.format(_RAW_WIDE), _RAW_NAMES, ["horizon_hours", "label"]))
def raw_to_trainset(spark, sf):
    """The whole way by the library's operators: item dictionary and reading names from labels, first events from raw
    inputs and procedures, cohort stays, readings extracted inside padded stays, hourly grid, windows, labels."""
    parts = d.part_items(spark, sf)
    events_of = dictionary.event_dictionary(parts, EVENT_WORDS, ["label", "abbreviation", "category"])
    variables = dictionary.last_wins(dictionary.match_labels(parts, READING_WORDS))
    raw = d.items(spark, sf)
    kinds = F.col("event_type")
    dose = F.greatest(F.col("value") - 60, F.lit(0.0))
    inputs = raw.where(kinds.isin("error", "purchase")).select("stay_id", "itemid", "starttime", F.lit(None).cast("double").alias("rate"), dose.alias("amount"))
    procedures = raw.where(kinds == "signup").select("stay_id", "itemid", "starttime")
    chart = raw.where(kinds.isin("click", "view")).select("stay_id", F.col("stay_id").alias("hadm_id"), F.col("starttime").alias("charttime"), "itemid", F.col("value").alias("valuenum"))
    cohort = d.stays(spark, sf).withColumn("hadm_id", F.col("stay_id"))
    firsts = events.detect(cohort, inputs, procedures, events_of)
    g = grid.hourly(events.attach(cohort, firsts.select("stay_id", "first_event_time"), "stay_id"), start_after_h=d.START_AFTER, event="first_event_time")
    readings = extract.vitals(chart, cohort, variables, d.PAD_HOURS)
    f = features.window_stats(g.select("stay_id", "index_time", "first_event_time"), readings, list(READING_WORDS), d.WINDOWS)
    return grid.label(f, "first_event_time", d.HORIZONS)


# -- declared extensions -------------------------------------------------------------------------------------------

_D1, _D1_NAMES = wide_sql([12], ["median", "iqr", "slope", "delta_pct"], ["view", "error"])


@query("d1_extra_window_stats", sql(window_ctes([12]), _D1, _D1_NAMES))
def d1(spark, sf):
    """Median, interquartile range, slope and relative change over 12 hours."""
    g = d.grid_points(spark, sf).select("stay_id", "index_time")
    s = d.extracted(spark, sf).where(F.col("variable").isin("view", "error"))
    return features.window_stats(g, s, ["view", "error"], [12], ["median", "iqr", "slope", "delta_pct"])


@query(
    "d1_missing_indicator",
    sql([*d.TIMELINE, d.EXTRACTED],
        "SELECT g.stay_id, g.index_time, CASE WHEN EXISTS (SELECT 1 FROM extracted s WHERE s.stay_id = g.stay_id AND s.variable = 'error' "
        "AND date_trunc('hour', s.charttime) > g.index_time - INTERVAL 12 HOUR AND date_trunc('hour', s.charttime) <= g.index_time) THEN 0.0 ELSE 1.0 END AS error__12h__missing FROM grid g",
        ["error__12h__missing"]),
)
def d1_missing(spark, sf):
    return _windows(spark, sf, windows=[12], stats=["missing"]).select("stay_id", "index_time", "error__12h__missing")


BURSTS = (
    "opened AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL {gap} MINUTE THEN 1 ELSE 0 END AS o "
    "FROM (SELECT user_id, ts, event_type, value FROM events WHERE {cond}) x WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "numbered AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM opened)"
)


@query("d2_debounce", sql([BURSTS.format(gap=240, cond="event_type IN ('click', 'view')")], "SELECT user_id, min(ts) AS burst_start, max(ts) AS burst_end, count(*) AS n_triggers FROM numbered GROUP BY user_id, b", ints=["n_triggers"]))
def d2(spark, sf):
    """Triggers less than four hours apart merge into one burst."""
    e = d.table(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    return events.debounce(e, ["user_id"], "ts", 240)


@query(
    "d3_rate_changes",
    sql([],
        "SELECT user_id, event_type, ts, value, previous_rate, CASE WHEN before <= 0 AND value > 0 THEN 'start' WHEN before > 0 AND (value - before >= 0.5 * before OR value - before >= 40) THEN 'upgrade' END AS change "
        "FROM (SELECT *, coalesce(previous_rate, 0) AS before FROM (SELECT user_id, event_type, ts, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS previous_rate "
        "FROM (SELECT user_id, event_type, ts, greatest(value - 20, 0) AS value FROM events) r) q) z WHERE change IS NOT NULL",
        ["value", "previous_rate"]),
)
def d3(spark, sf):
    """Starts and upgrades of a rate per entity and kind."""
    r = d.table(spark, sf, "events").select("user_id", "event_type", "ts", F.greatest(F.col("value") - 20, F.lit(0.0)).alias("value"))
    return events.rate_changes(r, ["user_id", "event_type"], "ts", "value", UPGRADE_RELATIVE, F.lit(40.0))


@query(
    "d4_confirmed_starts",
    sql([BURSTS.format(gap=600, cond="event_type = 'error' OR (event_type = 'view' AND value > 50)")],
        "SELECT user_id, min(ts) AS burst_start, max(ts) AS burst_end, count(*) AS n_triggers, bool_or(event_type = 'error') AS strong, bool_or(event_type = 'view' AND value > 50) AS supportive "
        "FROM numbered GROUP BY user_id, b HAVING bool_or(event_type = 'error') AND bool_or(event_type = 'view' AND value > 50)", ints=["n_triggers"]),
)
def d4(spark, sf):
    """Bursts with both a strong and a supportive signal."""
    e = d.table(spark, sf, "events")
    return events.confirmed_starts(e, ["user_id"], "ts", 600, F.col("event_type") == "error", (F.col("event_type") == "view") & (F.col("value") > 50), True)


@query("d5_preferred_source", sql([], "SELECT user_id, coalesce(min(ts) FILTER (event_type = 'signup' AND value > 150), min(ts) FILTER (NOT (event_type = 'signup' AND value > 150))) AS crrt_time FROM events GROUP BY 1"))
def d5(spark, sf):
    return events.preferred_first(d.table(spark, sf, "events"), "user_id", "ts", (F.col("event_type") == "signup") & (F.col("value") > 150), "crrt_time")


@query(
    "d6_year_split",
    sql(["spans AS (SELECT o_custkey, max(year(o_orderdate)) >= 2000 AS is_test, min(year(o_orderdate)) <= 1999 AS is_train FROM orders GROUP BY 1)",
         f"pool AS (SELECT o_custkey, row_number() OVER (ORDER BY {d.h60('o_custkey', seed=42)}) - 1 AS r, count(*) OVER () AS n FROM spans WHERE is_train AND NOT is_test)",
         "side AS (SELECT o_custkey, CASE WHEN r < ceil(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM pool UNION ALL SELECT o_custkey, 'test' FROM spans WHERE is_test)"],
        "SELECT o_orderkey, o.o_custkey, split FROM orders o JOIN side s ON o.o_custkey = s.o_custkey WHERE CASE WHEN split = 'test' THEN year(o_orderdate) BETWEEN 2000 AND 2001 ELSE year(o_orderdate) BETWEEN 1990 AND 1999 END"),
)
def d6(spark, sf):
    """Years first, then groups; a customer is in one split only."""
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return split.by_year(o, "o_orderdate", "o_custkey", (1990, 1999), (2000, 2001)).select("o_orderkey", "o_custkey", "split")


_D7, _D7_NAMES = wide_sql([24], ["mean", "last"], ["outflow", "drug_rate"])
_D7_SERIES = "series AS (SELECT user_id AS stay_id, ts AS charttime, CASE event_type WHEN 'purchase' THEN 'outflow' WHEN 'signup' THEN 'drug_rate' ELSE event_type END AS variable, value FROM events)"


@query("d7_output_and_intervention_features", sql([_D7_SERIES, d.STAYS, d.INSIDE, d.FIRSTS.replace("'signup'", "'drug_rate'").replace("'purchase'", "'outflow'"), d.FULLGRID, d.GRID, d.EXTRACTED, HOURLY.format(hour=FLOOR_HOUR), SEEN, tall_sql(24)], _D7, _D7_NAMES))
def d7(spark, sf):
    """More variables in the series are more columns; the operator is the same."""
    name = F.when(F.col("variable") == "purchase", "outflow").when(F.col("variable") == "signup", "drug_rate").otherwise(F.col("variable"))
    s = d.extracted(spark, sf).withColumn("variable", name)
    g = d.grid_points(spark, sf).select("stay_id", "index_time")
    return features.window_stats(g, s, ["outflow", "drug_rate"], [24], ["mean", "last"])
