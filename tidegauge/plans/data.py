"""The given tables in the roles the operators expect, in Spark and as SQL table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.ordered import hash60
from tidegauge.functions.spread import even_tasks, merged_maxima
from tidegauge.functions.timefn import plus_hours
from tidegauge.operators import events as ev
from tidegauge.operators import extract, grid

VARIABLES = ["click", "error", "purchase", "signup", "view"]
WINDOWS = [6, 24]
HORIZONS = [24, 48]
STAY_HOURS = 240
PAD_HOURS = 6
START_AFTER = 6
THRESHOLD = 0.6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, with zone-free times as instants (session zone UTC)."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


# -- series, stays, events, grid: from ``events`` -------------------------------------------------------


def series(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("stay_id"),
        F.col("ts").alias("charttime"),
        F.col("event_type").alias("variable"),
        "value",
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Events as item-coded rows; the item number sits in the JSON property ``k``."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("stay_id"),
        F.col("ts").alias("starttime"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("itemid"),
        "event_type",
        "value",
        "event_id",
    )


def stays(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("stay_id")).agg(F.min("ts").alias("icu_in")).withColumn("icu_out", plus_hours("icu_in", STAY_HOURS))


def inside(spark: SparkSession, sf: str, pad: float = 0.0) -> DataFrame:
    """Readings inside the (padded) stay of their entity."""
    padded = ev.padded_stay(stays(spark, sf), "icu_in", "icu_out", pad).select("stay_id", "win_start", "win_end")
    return extract.within_stay(series(spark, sf), padded, "stay_id", "charttime")


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    """What features are made from: readings inside the padded stay of a cohort entity, and no others."""
    return inside(spark, sf, PAD_HOURS)


def conditions() -> dict:
    v = F.col("variable")
    return {
        "vaso_time": (v == "error") & (F.col("value") > 60),
        "imv_time": (v == "signup") & (F.col("value") > 80),
        "crrt_time": (v == "purchase") & (F.col("value") > 120),
    }


def firsts(spark: SparkSession, sf: str) -> DataFrame:
    return ev.first_events(inside(spark, sf), "stay_id", "charttime", conditions())


def stays_with_event(spark: SparkSession, sf: str) -> DataFrame:
    return ev.attach(stays(spark, sf), firsts(spark, sf).select("stay_id", "first_event_time"), "stay_id")


def grid_points(spark: SparkSession, sf: str, mode: str = "prune") -> DataFrame:
    g = grid.hourly(stays_with_event(spark, sf), start_after_h=START_AFTER, event="first_event_time", mode=mode)
    return g.select("stay_id", "index_time", "first_event_time")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return grid.label(grid_points(spark, sf), "first_event_time", HORIZONS)


SERIES = "series AS (SELECT user_id AS stay_id, ts AS charttime, event_type AS variable, value FROM events)"
STAYS = f"stays AS (SELECT user_id AS stay_id, min(ts) AS icu_in, min(ts) + INTERVAL {STAY_HOURS} HOUR AS icu_out FROM events GROUP BY 1)"
INSIDE = (
    "inside AS (SELECT s.* FROM series s JOIN stays t ON s.stay_id = t.stay_id "
    "AND s.charttime BETWEEN t.icu_in AND t.icu_out)"
)
EXTRACTED = (
    "extracted AS (SELECT s.* FROM series s JOIN stays t ON s.stay_id = t.stay_id "
    f"AND s.charttime BETWEEN t.icu_in - INTERVAL {PAD_HOURS} HOUR AND t.icu_out + INTERVAL {PAD_HOURS} HOUR)"
)
FIRSTS = (
    "firsts AS (SELECT stay_id, min(charttime) FILTER (variable = 'error' AND value > 60) AS vaso_time, "
    "min(charttime) FILTER (variable = 'signup' AND value > 80) AS imv_time, "
    "min(charttime) FILTER (variable = 'purchase' AND value > 120) AS crrt_time, "
    "min(charttime) FILTER ((variable = 'error' AND value > 60) OR (variable = 'signup' AND value > 80) "
    "OR (variable = 'purchase' AND value > 120)) AS first_event_time FROM inside GROUP BY 1)"
)
FULLGRID = (
    "fullgrid AS (SELECT b.stay_id, unnest(generate_series(b.first_t, b.last_t, INTERVAL 1 HOUR)) AS index_time, b.first_event_time "
    "FROM (SELECT s.stay_id, f.first_event_time, "
    f"CASE WHEN date_trunc('hour', s.icu_in + INTERVAL {START_AFTER} HOUR) = s.icu_in + INTERVAL {START_AFTER} HOUR "
    f"THEN s.icu_in + INTERVAL {START_AFTER} HOUR ELSE date_trunc('hour', s.icu_in + INTERVAL {START_AFTER} HOUR) + INTERVAL 1 HOUR END AS first_t, "
    "date_trunc('hour', s.icu_out) - INTERVAL 1 HOUR AS last_t "
    "FROM stays s LEFT JOIN firsts f ON s.stay_id = f.stay_id) b WHERE b.first_t <= b.last_t)"
)
GRID = "grid AS (SELECT * FROM fullgrid WHERE first_event_time IS NULL OR index_time < first_event_time)"
LABELS = (
    "labels_all AS (SELECT g.stay_id, g.index_time, g.first_event_time, h.horizon_hours, "
    "CASE WHEN first_event_time > index_time AND first_event_time <= index_time + to_hours(h.horizon_hours) THEN 1 ELSE 0 END AS label "
    "FROM grid g, (SELECT unnest([24, 48]) AS horizon_hours) h)"
)
TIMELINE = [SERIES, STAYS, INSIDE, FIRSTS, FULLGRID, GRID]


# -- scored windows: from ``lineitem`` (and ``orders`` for event times) -----------------------------------


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(stay_id, index_time, label, prob), one row per key."""
    li = table(spark, sf, "lineitem")
    y = ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 10)) | (F.col("l_quantity") >= 46)
    p = F.round((F.col("l_quantity") + 100 * F.col("l_discount")) / 61.0, 6)
    rows = li.select(F.col("l_orderkey").alias("stay_id"), F.col("l_shipdate").alias("index_time"), y.cast("int").alias("label"), p.alias("prob"))
    return merged_maxima(rows, ["stay_id", "index_time"], ["label", "prob"], even_tasks(li))


def event_times(spark: SparkSession, sf: str) -> DataFrame:
    """An event 90 days after each order."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("stay_id"), plus_hours("o_orderdate", 90 * 24).alias("first_event_time"))


def scored_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Scored windows with a horizon, split and method, as several stored prediction tables would give."""
    s = scored(spark, sf)
    h = F.when(F.pmod(F.year("index_time"), F.lit(2)) == 0, 24).otherwise(48)
    part = F.when(F.month("index_time") <= 6, "val").otherwise("test")
    raw = s.withColumns({"horizon": h, "split": part, "method": F.lit("raw")})
    cal = raw.withColumns({"method": F.lit("squared"), "prob": F.col("prob") * F.col("prob")})
    return raw.unionByName(cal)


SCORED = (
    "scored AS (SELECT l_orderkey AS stay_id, l_shipdate AS index_time, "
    "max(CASE WHEN (l_returnflag = 'R' AND l_quantity >= 10) OR l_quantity >= 46 THEN 1 ELSE 0 END) AS label, "
    "max(round((l_quantity + 100 * l_discount) / 61.0, 6)) AS prob FROM lineitem GROUP BY 1, 2)"
)
SCORED_EVENT = (
    "scored_event AS (SELECT s.*, o.o_orderdate + INTERVAL 2160 HOUR AS first_event_time "
    "FROM scored s LEFT JOIN orders o ON s.stay_id = o.o_orderkey)"
)
SPLITS = (
    "raw_splits AS (SELECT s.*, CASE WHEN year(index_time) % 2 = 0 THEN 24 ELSE 48 END AS horizon, "
    "CASE WHEN month(index_time) <= 6 THEN 'val' ELSE 'test' END AS split, 'raw' AS method FROM scored s)",
    "splits AS (SELECT * FROM raw_splits UNION ALL BY NAME SELECT * REPLACE ('squared' AS method, prob * prob AS prob) FROM raw_splits)",
)
POOLED = "pooled AS (SELECT stay_id, max(label) AS label, max(prob) AS prob FROM scored GROUP BY 1)"
STAY_ALERTS = (
    f"stay_alerts AS (SELECT stay_id, max(label) AS stay_label, max(prob) AS max_prob, "
    f"min(index_time) FILTER (prob >= {THRESHOLD}) AS first_alert_time, "
    f"CASE WHEN max(prob) >= {THRESHOLD} THEN 1 ELSE 0 END AS stay_pred FROM scored GROUP BY 1)"
)


# -- cohort tables: from ``customer``, ``orders``, ``lineitem``, ``part`` ---------------------------------

PREFIXES = {9: ["Brand#2"], 10: ["Brand#1"]}


def patients(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("subject_id"), F.floor(F.col("c_acctbal") / 100).alias("anchor_age"), F.col("c_mktsegment").alias("gender"))


def admissions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderdate").alias("admittime"),
        plus_hours("o_orderdate", 720).alias("dischtime"),
    )


def unit_stays(spark: SparkSession, sf: str) -> DataFrame:
    """A stay per line; the line's quantity is its length in hours. Its id is a hash of the line's keys."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        hash60("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("stay_id"),
        F.col("l_returnflag").alias("first_careunit"),
        F.col("l_linestatus").alias("last_careunit"),
        F.col("l_shipdate").alias("intime"),
        plus_hours("l_shipdate", F.col("l_quantity")).alias("outtime"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity") / 24).alias("los"),
    )
    return li.join(admissions(spark, sf).select("subject_id", "hadm_id"), "hadm_id")


def diagnoses(spark: SparkSession, sf: str) -> DataFrame:
    """A code per line: the part's brand; the code system is 10 for even sizes and 9 for odd ones."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), F.col("l_partkey").alias("p_partkey"))
    p = table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("icd_code"), F.when(F.pmod("p_size", F.lit(2)) == 0, "10").otherwise("9").alias("icd_version")
    )
    o = admissions(spark, sf).select("subject_id", "hadm_id")
    return li.join(p, "p_partkey").join(o, "hadm_id").select("subject_id", "hadm_id", "icd_code", "icd_version")


def _h60(*cols: str, seed: int = 0) -> str:
    text = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST('0x' || substr(md5(concat_ws('|', {text}, '{seed}')), 1, 15) AS BIGINT)"


h60 = _h60
PATIENTS = "patients AS (SELECT c_custkey AS subject_id, CAST(floor(c_acctbal / 100) AS BIGINT) AS anchor_age, c_mktsegment AS gender FROM customer)"
ADMISSIONS = (
    "admissions AS (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime, "
    "o_orderdate + INTERVAL 720 HOUR AS dischtime FROM orders)"
)
UNIT_STAYS = (
    f"unit_stays AS (SELECT l_orderkey AS hadm_id, {_h60('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} AS stay_id, "
    "l_returnflag AS first_careunit, l_linestatus AS last_careunit, l_shipdate AS intime, "
    "l_shipdate + to_hours(CAST(l_quantity AS BIGINT)) AS outtime, CASE WHEN l_tax > 0 THEN l_quantity / 24 END AS los, a.subject_id "
    "FROM lineitem JOIN admissions a ON l_orderkey = a.hadm_id)"
)
DIAGNOSES = (
    "diagnoses AS (SELECT a.subject_id, a.hadm_id, p_brand AS icd_code, CASE WHEN p_size % 2 = 0 THEN '10' ELSE '9' END AS icd_version "
    "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN admissions a ON l_orderkey = a.hadm_id)"
)
CODED = (
    "coded AS (SELECT DISTINCT subject_id, hadm_id FROM diagnoses WHERE (icd_version = '9' AND icd_code LIKE 'Brand#2%') "
    "OR (icd_version = '10' AND icd_code LIKE 'Brand#1%'))"
)
COHORT_PARTS = [PATIENTS, ADMISSIONS, UNIT_STAYS, DIAGNOSES, CODED]


# -- dictionary: from ``part`` ----------------------------------------------------------------------------

BANK = {"plate": ["plate"], "rod": ["rod"], "red": ["red"], "ring": ["ring", "bearing"]}


def part_items(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"), F.col("p_brand").alias("abbreviation"), F.col("p_type").alias("category")
    )
