"""Queries over scans, filters, joins, aggregates, windows, sorts, unions and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions import parsing, timefn
from tidegauge.functions.ordered import hash60, head, previous_value, quantiles, running_sums, value_bucket
from tidegauge.functions.scoring import clip, edges_at_or_below, interpolate, logit, platt
from tidegauge.functions.vocab import DRUG_NAMES, FEATURE_GROUPS
from tidegauge.operators import cohort, dictionary, events, evaluate, extract, features, model, quality
from tidegauge.plans import data as d
from tidegauge.plans.catalog import query, sql
from tidegauge.session import new_path
from tidegauge.sources import tables, writers

LINE_SCHEMA = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _as_files(spark, sf, name, columns=None, gz=True):
    """A given table as delimited files ``hosp/<name>.csv[.gz]`` parts, the form raw tables come in."""
    df = d.table(spark, sf, name)
    df = df.select(*columns) if columns else df
    root = new_path(spark, f"raw-{name}")
    parts = f"{root}/hosp/parts"
    df.write.option("header", True).option("compression", "gzip" if gz else "none").csv(parts)
    return root, parts


# -- scans, sources, sinks --------------------------------------------------------------------------------


@query("s1_table_scan", sql([], "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_shipdate FROM lineitem", ["l_quantity", "l_discount"], ["l_linenumber"]))
def s1(spark, sf):
    """Delimited, compressed files read back with a declared schema."""
    _, parts = _as_files(spark, sf, "lineitem")
    df = spark.read.schema(LINE_SCHEMA).option("header", True).csv(parts)
    return df.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")


@query("s2_list_tables", sql([], "SELECT DISTINCT lower(event_type) AS table_name FROM events"))
def s2(spark, sf):
    """Table names found below an area: one folder of files per event type, named after it."""
    root = new_path(spark, "areas")
    e = d.table(spark, sf, "events")
    e.withColumn("kind", F.lower("event_type")).write.partitionBy("kind").option("header", True).csv(f"{root}/icu")
    _name_files(spark, f"{root}/icu")
    return tables.list_tables(spark, root, "icu")


def _name_files(spark, folder):
    """Give the files of ``kind=x`` folders the name ``x.csv``, as raw table folders have."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in tables._files(spark, folder, True):
        parent = f.rsplit("/", 2)[-2]
        if parent.startswith("kind=") and f.endswith(".csv"):
            number = f.rsplit("/", 1)[-1].split("-")[1]
            target = f"{folder}/{parent[5:]}/{number}"
            fs.mkdirs(path(target))
            fs.rename(path(f), path(f"{target}/{parent[5:]}.csv"))


@query("s3_projected_scan", sql([], "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40", ["l_quantity"]))
def s3(spark, sf):
    """Projection and predicate both reach the scan."""
    return tables.shaped(d.table(spark, sf, "lineitem"), ["l_orderkey", "l_quantity"], (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40))


@query("s4_bounded_read", sql([], "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", ["o_totalprice"]))
def s4(spark, sf):
    """Filtered first rows in an explicit order."""
    o = tables.shaped(d.table(spark, sf, "orders"), where=F.col("o_orderstatus") == "F")
    return o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("s5_count_rows", sql([], "SELECT count(*) AS n_rows FROM events WHERE event_type = 'error'", ints=["n_rows"]))
def s5(spark, sf):
    return tables.count_rows(d.table(spark, sf, "events"), F.col("event_type") == "error")


@query("s6_equality_filter", sql([], "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"))
def s6(spark, sf):
    cond = tables.equals_all({"o_orderstatus": "O", "o_orderpriority": "1-URGENT"})
    return tables.shaped(d.table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"], cond)


@query("s7_bad_rows_skipped", sql([], "SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'error'", ["value"]))
def s7(spark, sf):
    """Rows whose value is no number are skipped; here every error row is written that way."""
    e = d.table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value")
    )
    root = new_path(spark, "bad-rows")
    e.write.option("header", True).csv(root)
    good = spark.read.schema(EVENT_SCHEMA).option("header", True).option("mode", "DROPMALFORMED").csv(root)
    return good.select("event_id", "user_id", "event_type", "value")


@query("s7_bad_rows_kept", sql([], "SELECT event_type, count(*) AS n_bad FROM events WHERE event_type = 'error' GROUP BY 1", ints=["n_bad"]))
def s7_side(spark, sf):
    """The same bad rows as a side table."""
    e = d.table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value")
    )
    root = new_path(spark, "bad-rows")
    e.write.option("header", True).csv(root)
    bad = tables.bad_rows(spark, [root], EVENT_SCHEMA)
    return bad.groupBy(F.split("line", ",").getItem(3).alias("event_type")).agg(F.count(F.lit(1)).alias("n_bad"))


@query("s8_csv_to_parquet", sql([], "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount >= 0.05", ["l_extendedprice"], ["l_linenumber"]))
def s8(spark, sf):
    """Delimited files to a projected, filtered zstd parquet copy, read back."""
    _, parts = _as_files(spark, sf, "lineitem")
    raw = spark.read.schema(LINE_SCHEMA).option("header", True).csv(parts)
    out = new_path(spark, "copy")
    writers.to_parquet(raw, out, ["l_orderkey", "l_linenumber", "l_extendedprice"], F.col("l_discount") >= 0.05)
    return tables.read_parquet(spark, out)


@query("s9_column_read", sql([], "SELECT user_id, ts FROM events"))
def s9(spark, sf):
    return d.table(spark, sf, "events").select("user_id", "ts")


@query("s10_write_policy", sql([], "SELECT 'skip' AS policy, count(*) AS n_rows FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'overwrite', count(*) FROM orders WHERE o_orderstatus = 'O'", ints=["n_rows"]))
def s10(spark, sf):
    """A second write that skips leaves the first table; one that overwrites replaces it."""
    o = d.table(spark, sf, "orders")
    kept, replaced = new_path(spark, "kept"), new_path(spark, "replaced")
    for path, policy in ((kept, "skip"), (replaced, "overwrite")):
        writers.to_parquet(o, path, where=F.col("o_orderstatus") == "F")
        writers.to_parquet(o, path, where=F.col("o_orderstatus") == "O", if_exists=policy)
    n = F.count(F.lit(1)).alias("n_rows")
    return spark.read.parquet(kept).agg(n).select(F.lit("skip").alias("policy"), "n_rows").unionByName(
        spark.read.parquet(replaced).agg(n).select(F.lit("overwrite").alias("policy"), "n_rows")
    )


@query("s11_report_sinks", sql([], "SELECT f.fmt, o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders, (VALUES ('csv'), ('json'), ('parquet')) f(fmt) GROUP BY 1, 2", ["total"], ["n_orders"]))
def s11(spark, sf):
    """One report in all three formats, read back."""
    rep = d.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = new_path(spark, f"report-{fmt}")
        writers.report(rep, path, fmt)
        back = spark.read.schema("o_orderstatus string, n_orders long, total double").option("header", True).format(fmt).load(path)
        back = back.withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out.withColumn("total", F.round("total", 2))


@query(
    "s14_filter_funnel",
    sql(
        [],
        "SELECT 0 AS step, 'all' AS filter, count(*) AS n_alone, count(*) AS n_together FROM events "
        "UNION ALL SELECT 1, 'item', count(*) FILTER (event_type IN ('error', 'signup')), count(*) FILTER (event_type IN ('error', 'signup')) FROM events "
        "UNION ALL SELECT 2, 'entity', count(*) FILTER (user_id < 50), count(*) FILTER (event_type IN ('error', 'signup') AND user_id < 50) FROM events "
        "UNION ALL SELECT 3, 'time', count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'), "
        "count(*) FILTER (event_type IN ('error', 'signup') AND user_id < 50 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20') FROM events",
        ints=["step", "n_alone", "n_together"],
    ),
)
def s14(spark, sf):
    """Which filter loses the rows: alone and one after the other, from one pass."""
    t = F.col("ts")
    return quality.funnel(
        d.table(spark, sf, "events"),
        {
            "item": F.col("event_type").isin("error", "signup"),
            "entity": F.col("user_id") < 50,
            "time": (t >= F.lit("2024-01-10").cast("timestamp")) & (t < F.lit("2024-01-20").cast("timestamp")),
        },
    )


# -- projections, filters, predicates ----------------------------------------------------------------------


@query("p1_threshold_filter", sql([d.PATIENTS], "SELECT subject_id, anchor_age FROM patients WHERE anchor_age >= 18"))
def p1(spark, sf):
    return d.patients(spark, sf).where(F.col("anchor_age") >= 18).select("subject_id", "anchor_age")


@query("p2_versioned_prefix", sql(d.COHORT_PARTS, "SELECT subject_id, hadm_id FROM coded"))
def p2(spark, sf):
    dx = d.diagnoses(spark, sf)
    return dx.where(cohort.code_match("icd_code", "icd_version", d.PREFIXES)).select("subject_id", "hadm_id").distinct()


@query("p3_length_of_stay", sql([d.ADMISSIONS, d.UNIT_STAYS], "SELECT stay_id, coalesce(los * 24, epoch(outtime - intime) / 3600.0) AS los_hours FROM unit_stays", ["los_hours"]))
def p3(spark, sf):
    return d.unit_stays(spark, sf).select("stay_id", cohort.length_of_stay("los", "intime", "outtime").alias("los_hours"))


COHORT_SQL = (
    "SELECT subject_id, hadm_id, stay_id, intime AS icu_in, outtime AS icu_out, los_hours, anchor_age AS age, gender, "
    "first_careunit, last_careunit, admittime, dischtime FROM ("
    "SELECT s.*, a.admittime, a.dischtime, p.anchor_age, p.gender, coalesce(los * 24, epoch(outtime - intime) / 3600.0) AS los_hours, "
    "row_number() OVER (PARTITION BY s.subject_id ORDER BY intime, stay_id) AS rn FROM unit_stays s "
    "JOIN coded c ON s.subject_id = c.subject_id AND s.hadm_id = c.hadm_id "
    "JOIN admissions a ON s.hadm_id = a.hadm_id JOIN patients p ON s.subject_id = p.subject_id WHERE p.anchor_age >= 0) q "
    "WHERE rn = 1 AND los_hours >= 24"
)


def _cohort(spark, sf):
    return cohort.build(d.patients(spark, sf), d.admissions(spark, sf), d.unit_stays(spark, sf), d.diagnoses(spark, sf), min_age=0, prefixes=d.PREFIXES)


@query("p4_cohort", sql(d.COHORT_PARTS, COHORT_SQL, ["los_hours"], ["age"]))
def p4(spark, sf):
    """First coded stay per subject; the length filter comes after the choice."""
    return _cohort(spark, sf)


@query("p5_rename_order", sql([], "SELECT c_custkey AS subject_id, c_mktsegment AS gender, c_acctbal AS balance FROM customer", ["balance"]))
def p5(spark, sf):
    c = d.table(spark, sf, "customer").withColumnsRenamed({"c_custkey": "subject_id", "c_mktsegment": "gender", "c_acctbal": "balance"})
    return c.select("subject_id", "gender", "balance")


@query("p6_distinct_rows", sql([], "SELECT DISTINCT user_id, event_type FROM events"))
def p6(spark, sf):
    return d.table(spark, sf, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


ITEMS = "items AS (SELECT user_id AS stay_id, ts AS starttime, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid, event_type, value, event_id FROM events)"


@query("p7_membership", sql([ITEMS, d.STAYS], "SELECT event_id, stay_id, itemid FROM items WHERE stay_id IN (SELECT stay_id FROM stays WHERE icu_in < TIMESTAMP '2024-01-01 06:00:00') AND itemid BETWEEN 10 AND 19"))
def p7(spark, sf):
    early = d.stays(spark, sf).where(F.col("icu_in") < F.lit("2024-01-01 06:00:00").cast("timestamp"))
    listed = d.items(spark, sf).where(F.col("itemid").between(10, 19))
    return events.members(listed, early, "stay_id").select("event_id", "stay_id", "itemid")


@query("p8_positive_dose", sql([], "SELECT event_id FROM events WHERE (coalesce(CASE WHEN event_type = 'click' THEN value END, 0) > 0 OR coalesce(CASE WHEN event_type = 'view' THEN value - 20 END, 0) > 0) AND ts IS NOT NULL"))
def p8(spark, sf):
    """Clicks play the rate, views the amount."""
    e = d.table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("starttime"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("rate"),
        F.when(F.col("event_type") == "view", F.col("value") - 20).alias("amount"),
    )
    return e.where(events.positive_dose()).select("event_id")


PADDED = "padded AS (SELECT s.stay_id, s.charttime, s.variable, s.value FROM series s JOIN stays t ON s.stay_id = t.stay_id AND s.charttime BETWEEN t.icu_in - INTERVAL 6 HOUR AND t.icu_out + INTERVAL 6 HOUR)"


@query("p9_padded_time_filter", sql([d.SERIES, d.STAYS, PADDED], "SELECT variable, count(*) AS n, min(charttime) AS first_t, max(charttime) AS last_t FROM padded GROUP BY 1", ints=["n"]))
def p9(spark, sf):
    inside = d.inside(spark, sf, 6.0)
    return inside.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.min("charttime").alias("first_t"), F.max("charttime").alias("last_t"))


@query("p10_null_drop", sql([], "SELECT event_id, v FROM (SELECT event_id, CASE WHEN value > 20 THEN value END AS v, nullif(event_type, 'view') AS k FROM events) q WHERE v IS NOT NULL AND k IS NOT NULL", ["v"]))
def p10(spark, sf):
    e = d.table(spark, sf, "events").select("event_id", F.when(F.col("value") > 20, F.col("value")).alias("v"), F.nullif("event_type", F.lit("view")).alias("k"))
    return e.na.drop(subset=["v", "k"]).select("event_id", "v")


@query(
    "p11_safe_coercion",
    sql([], "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS first_digit, TRY_CAST(o_orderpriority AS DOUBLE) AS as_number, "
        "TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE CAST(o_orderdate AS VARCHAR) END AS TIMESTAMP) AS as_time FROM orders", ["as_number"]),
)
def p11(spark, sf):
    """What cannot be read becomes null."""
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("o_orderdate").cast("string"))
    return d.table(spark, sf, "orders").select(
        "o_orderkey", parsing.to_long(F.substring("o_orderpriority", 1, 1)).alias("first_digit"), parsing.to_double("o_orderpriority").alias("as_number"),
        parsing.to_time(text).alias("as_time"),
    )


@query(
    "p12_row_value",
    sql([], "SELECT event_id, v FROM (SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN value END, TRY_CAST(CASE WHEN value > 10 THEN CAST(value AS VARCHAR) ELSE 'low' END AS DOUBLE)) AS v FROM events) q WHERE v IS NOT NULL", ["v"]),
)
def p12(spark, sf):
    """Row by row: the number, else the text."""
    e = d.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("valuenum"),
        F.when(F.col("value") > 10, F.col("value").cast("string")).otherwise("low").alias("value"),
    )
    return e.select("event_id", parsing.coalesced_value("valuenum", "value").alias("v")).where(F.col("v").isNotNull())


@query("p13_column_value", sql([], "SELECT user_id AS stay_id, ts AS charttime, CAST(regexp_extract(props, '-?[0-9]+[.]?[0-9]*') AS BIGINT) AS itemid, CAST(regexp_extract(props, '-?[0-9]+[.]?[0-9]*') AS DOUBLE) AS value FROM events", ["value"]))
def p13(spark, sf):
    """Whole column: no numeric column here, so the first number of the text is used."""
    e = d.table(spark, sf, "events").select(
        F.col("user_id").alias("stay_id"), F.col("ts").alias("charttime"), F.col("props").alias("value"), F.get_json_object("props", "$.k").alias("itemid")
    )
    return parsing.normalized(e, ["stay_id"])


@query("p14_first_existing_column", sql([], "SELECT doc_id, toxic AS label, quality FROM labels", ints=["label", "quality"]))
def p14(spark, sf):
    df = d.table(spark, sf, "labels").withColumnRenamed("toxic", "outcome")
    return df.select("doc_id", F.col(parsing.first_existing(df, parsing.LABEL_COLUMNS)).alias("label"), "quality")


def _sparse(spark, sf):
    """Order columns with some made mostly null or constant, as wide feature tables have."""
    o = d.table(spark, sf, "orders")
    return o.select(
        "o_custkey", "o_totalprice",
        F.when(F.col("o_totalprice") > 490000, F.col("o_totalprice")).alias("rare"),
        F.lit(3.0).alias("constant"),
        F.lit(None).cast("double").alias("empty"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("half"),
    )


SPARSE = "sparse AS (SELECT o_custkey, o_totalprice, CASE WHEN o_totalprice > 490000 THEN o_totalprice END AS rare, 3.0 AS constant, CAST(NULL AS DOUBLE) AS empty, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS half FROM orders)"
SPARSE_COLUMNS = ["o_custkey", "o_totalprice", "rare", "constant", "empty", "half"]
_QUALITY = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS missing_rate, stddev_pop({c}) AS std FROM sparse" for c in SPARSE_COLUMNS
)


@query("p15_usable_columns", sql([SPARSE], f"SELECT * FROM ({_QUALITY}) q WHERE missing_rate < 0.95 AND std IS NOT NULL AND std <> 0", ["missing_rate", "std"]))
def p15(spark, sf):
    """Columns neither too empty nor constant, judged in one pass."""
    return quality.usable(quality.column_quality(_sparse(spark, sf)))


@query("p16_align_columns", sql([], "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS absent, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders", ["absent", "o_totalprice", "o_custkey"]))
def p16(spark, sf):
    return quality.align_columns(d.table(spark, sf, "orders"), ["absent", "o_totalprice", "o_custkey"], ["o_orderkey"])


# -- joins --------------------------------------------------------------------------------------------------


@query("j1_composite_inner", sql(d.COHORT_PARTS, "SELECT a.subject_id, a.hadm_id, a.admittime, p.anchor_age FROM admissions a JOIN coded c ON a.subject_id = c.subject_id AND a.hadm_id = c.hadm_id JOIN patients p ON a.subject_id = p.subject_id"))
def j1(spark, sf):
    dx = d.diagnoses(spark, sf)
    coded = dx.where(cohort.code_match("icd_code", "icd_version", d.PREFIXES)).select("subject_id", "hadm_id").distinct()
    out = d.admissions(spark, sf).join(coded, ["subject_id", "hadm_id"]).join(d.patients(spark, sf), "subject_id")
    return out.select("subject_id", "hadm_id", "admittime", "anchor_age")


@query("j2_left_lookup", sql([], "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey"))
def j2(spark, sf):
    n = d.table(spark, sf, "nation").where(F.col("n_regionkey") < 3)
    s = d.table(spark, sf, "supplier")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select("s_suppkey", "s_name", "n_name")


@query("j3_semi", sql([], "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')", ["l_quantity"]))
def j3(spark, sf):
    p = d.table(spark, sf, "part").where(F.col("p_size") == 7).select(F.col("p_partkey").alias("l_partkey"))
    o = d.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    li = d.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return li.join(p, "l_partkey", "left_semi").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_partkey", "l_quantity")


@query("j4_first_events_attached", sql(d.TIMELINE[:4], "SELECT s.stay_id, vaso_time, imv_time, crrt_time, first_event_time FROM stays s LEFT JOIN firsts f ON s.stay_id = f.stay_id"))
def j4(spark, sf):
    """All categories in one conditional aggregation, then one join."""
    return events.attach(d.stays(spark, sf).select("stay_id"), d.firsts(spark, sf), "stay_id")


@query("j5_interval_join", sql(d.TIMELINE[:3], "SELECT stay_id, charttime, variable, value FROM inside", ["value"]))
def j5(spark, sf):
    return d.inside(spark, sf).select("stay_id", "charttime", "variable", "value")


@query(
    "j6_coalesced_columns",
    sql([d.ADMISSIONS, d.UNIT_STAYS],
        "SELECT r.rid, s.stay_id, coalesce(s.unit, r.unit) AS unit FROM (SELECT l_orderkey AS hadm_id, l_shipdate AS t, l_returnflag AS unit, "
        f"{d.h60('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} AS rid FROM lineitem) r "
        "JOIN (SELECT hadm_id, stay_id, intime, outtime, CASE WHEN last_careunit = 'F' THEN first_careunit END AS unit FROM unit_stays) s "
        "ON r.hadm_id = s.hadm_id AND r.t BETWEEN s.intime AND s.outtime"),
)
def j6(spark, sf):
    """A column on both sides is taken from the stay, else from the reading."""
    r = d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"), F.col("l_shipdate").alias("t"), F.col("l_returnflag").alias("unit"),
        hash60("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
    )
    s = d.unit_stays(spark, sf).select("hadm_id", "stay_id", "intime", "outtime", F.when(F.col("last_careunit") == "F", F.col("first_careunit")).alias("unit"))
    return extract.within_stay(r, s, "hadm_id", "t", "intime", "outtime").select("rid", "stay_id", "unit")


@query("j7_rekey", sql(d.COHORT_PARTS, "SELECT c.hadm_id, c.subject_id, s.stay_id FROM coded c LEFT JOIN unit_stays s ON c.hadm_id = s.hadm_id"))
def j7(spark, sf):
    """One admission may fan out to several stays."""
    dx = d.diagnoses(spark, sf)
    coded = dx.where(cohort.code_match("icd_code", "icd_version", d.PREFIXES)).select("subject_id", "hadm_id").distinct()
    return coded.join(d.unit_stays(spark, sf).select("hadm_id", "stay_id"), "hadm_id", "left")


@query("j11_scores_missing_dropped", sql([d.SCORED], "SELECT stay_id, index_time, label, CASE WHEN year(index_time) <> 1998 THEN prob END AS prob FROM scored WHERE year(index_time) <> 1998", ["prob"], ["label"]))
def j11_drop(spark, sf):
    s = d.scored(spark, sf)
    return evaluate.join_scores(s.drop("prob"), s.where(F.year("index_time") != 1998))


@query("j11_scores_missing_zero", sql([d.SCORED], "SELECT stay_id, index_time, label, CASE WHEN year(index_time) <> 1998 THEN prob ELSE 0.0 END AS prob FROM scored", ["prob"], ["label"]))
def j11_zero(spark, sf):
    s = d.scored(spark, sf)
    return evaluate.join_scores(s.drop("prob"), s.where(F.year("index_time") != 1998), missing="zero")


@query("j12_split_alignment", sql([d.SCORED], "SELECT stay_id, index_time, label FROM scored WHERE month(index_time) <= 6", ints=["label"]))
def j12(spark, sf):
    """Rows whose key is among the predictions of a split."""
    s = d.scored(spark, sf)
    keys = s.where(F.month("index_time") <= 6).select("stay_id", "index_time")
    return s.select("stay_id", "index_time", "label").join(keys, ["stay_id", "index_time"], "left_semi")


# -- aggregations --------------------------------------------------------------------------------------------


@query("a1_first_event", sql(d.TIMELINE[:3], "SELECT stay_id, variable, min(charttime) AS first_t FROM inside GROUP BY 1, 2"))
def a1(spark, sf):
    return d.inside(spark, sf).groupBy("stay_id", "variable").agg(F.min("charttime").alias("first_t"))


@query("a2_row_earliest", sql(d.TIMELINE[:4], "SELECT stay_id, first_event_time FROM firsts"))
def a2(spark, sf):
    return d.firsts(spark, sf).select("stay_id", events.earliest(["vaso_time", "imv_time", "crrt_time"]).alias("first_event_time"))


@query("a3_hourly_mean", sql([d.SERIES], "SELECT stay_id, variable, date_trunc('hour', charttime) AS hour, avg(value) AS mean FROM series GROUP BY 1, 2, 3", ["mean"]))
def a3(spark, sf):
    return features.resample(d.series(spark, sf), ["stay_id", "variable"], "charttime", "value")


_PIVOT = ", ".join(f"avg(value) FILTER (variable = '{v}') AS {v}" for v in d.VARIABLES)


@query("a4_pivot", sql([d.SERIES], f"SELECT stay_id, date_trunc('hour', charttime) AS hour, {_PIVOT} FROM series GROUP BY 1, 2", d.VARIABLES))
def a4(spark, sf):
    return features.pivot_hours(d.series(spark, sf), "stay_id", "charttime", "variable", "value", d.VARIABLES)


@query("a5_max_pooling", sql([d.SCORED, d.POOLED], "SELECT * FROM pooled", ["prob"], ["label"]))
def a5(spark, sf):
    return evaluate.pool(d.scored(spark, sf))


@query("a6_first_alert", sql([d.SCORED, d.STAY_ALERTS], "SELECT stay_id, first_alert_time FROM stay_alerts"))
def a6(spark, sf):
    return evaluate.entity_alerts(d.scored(spark, sf), d.THRESHOLD).select("stay_id", "first_alert_time")


@query("a7_label_stats", sql([*d.TIMELINE, d.LABELS], "SELECT horizon_hours, count(*) AS n, sum(label) AS positives, round(avg(label) * 100, 2) AS rate_pct FROM labels_all GROUP BY 1", ["rate_pct"], ["horizon_hours", "n", "positives"]))
def a7(spark, sf):
    return quality.label_stats(d.labels(spark, sf))


@query("a8_basic_counts", sql([d.SCORED], "SELECT count(*) AS n_rows, count(DISTINCT stay_id) AS n_entities, avg(label) AS positive_rate, min(index_time) AS time_min, max(index_time) AS time_max FROM scored", ["positive_rate"], ["n_rows", "n_entities"]))
def a8(spark, sf):
    return quality.basic_counts(d.scored(spark, sf), "stay_id", "label", "index_time")


@query(
    "a9_entity_profile",
    sql([d.SCORED],
        "SELECT count(*) AS n_entities, avg(y) AS positive_rate, quantile_cont(w, 0.5) AS windows_median, quantile_cont(w, 0.1) AS windows_p10, "
        "quantile_cont(w, 0.9) AS windows_p90, quantile_cont(h, 0.5) AS span_hours_median FROM (SELECT max(label) AS y, CAST(count(*) AS DOUBLE) AS w, "
        "epoch(max(index_time) - min(index_time)) / 3600.0 AS h FROM scored GROUP BY stay_id) q",
        ["positive_rate", "windows_median", "windows_p10", "windows_p90", "span_hours_median"], ["n_entities"]),
)
def a9(spark, sf):
    return quality.entity_profile(d.scored(spark, sf), "stay_id", "label", "index_time")


@query("a10_demographics", sql([], "SELECT count(c_acctbal) AS n, avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max, quantile_cont(c_acctbal, 0.25) AS p25, quantile_cont(c_acctbal, 0.5) AS p50, quantile_cont(c_acctbal, 0.75) AS p75 FROM customer", ["mean", "std", "min", "max", "p25", "p50", "p75"], ["n"]))
def a10(spark, sf):
    return quality.describe(d.table(spark, sf, "customer"), "c_acctbal", std="population", named={"p25": 0.25, "p50": 0.5, "p75": 0.75})


@query("a10_top_categories", sql([], "SELECT upper(p_name) AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20", ints=["n"]))
def a10_top(spark, sf):
    return quality.value_counts(d.table(spark, sf, "part"), "p_name", top=20, upper=True)


@query("a11_missingness", sql([SPARSE], " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS missing_rate FROM sparse" for c in SPARSE_COLUMNS), ["missing_rate"]))
def a11(spark, sf):
    return quality.missingness(_sparse(spark, sf))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DESCRIBE = "count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, " + ", ".join(
    f"quantile_cont({{c}}, {q}) AS {n}" for n, q in quality.DESCRIBE.items()
)
_STAT_COLUMNS = ["mean", "std", "min", "max", *quality.DESCRIBE]


@query("a12_numeric_profile", sql([], " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS missing_rate, {_DESCRIBE.format(c=c)} FROM lineitem" for c in _NUM), ["missing_rate", *_STAT_COLUMNS], ["n"]))
def a12(spark, sf):
    """Every numeric column at once; quantiles are exact."""
    return quality.numeric_profile(d.table(spark, sf, "lineitem").select(*_NUM))


@query("a13_describe_measure", sql([], f"SELECT o_orderstatus, {_DESCRIBE.format(c='o_totalprice')} FROM orders GROUP BY 1", _STAT_COLUMNS, ["n"]))
def a13(spark, sf):
    return quality.describe(d.table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"])


@query("a14_value_counts", sql([], "SELECT nullif(event_type, 'view') AS value, count(*) AS n FROM events GROUP BY 1", ints=["n"]))
def a14(spark, sf):
    e = d.table(spark, sf, "events").withColumn("k", F.nullif("event_type", F.lit("view")))
    return quality.value_counts(e, "k")


@query("a15_quantiles", sql([], " UNION ALL ".join(f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS p, quantile_cont(l_extendedprice, {p}) AS q FROM lineitem GROUP BY 1" for p in (0.01, 0.1, 0.5, 0.9, 0.999)), ["p", "q"]))
def a15(spark, sf):
    """Exact interpolated quantiles without holding a group in one place."""
    return quantiles(d.table(spark, sf, "lineitem"), "l_extendedprice", [0.01, 0.1, 0.5, 0.9, 0.999], ["l_returnflag"])


@query("a16_fullest_columns", sql([d.SERIES], "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{v}__mean' AS feature, avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1 END) AS non_null_rate FROM (SELECT avg(value) FILTER (variable = '{v}') AS x FROM series GROUP BY stay_id, date_trunc('hour', charttime)) q" for v in d.VARIABLES) + ") u ORDER BY non_null_rate DESC, feature LIMIT 3", ["non_null_rate"]))
def a16(spark, sf):
    wide = features.pivot_hours(d.series(spark, sf), "stay_id", "charttime", "variable", "value", d.VARIABLES)
    return features.fullest(wide.withColumnsRenamed({v: f"{v}__mean" for v in d.VARIABLES}), n=3)


# -- windows ---------------------------------------------------------------------------------------------------


@query("w2_first_row_per_group", sql(d.COHORT_PARTS, "SELECT subject_id, stay_id, intime FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) AS rn FROM unit_stays) q WHERE rn = 1"))
def w2(spark, sf):
    return cohort.first_per_group(d.unit_stays(spark, sf).select("subject_id", "stay_id", "intime"), ["subject_id"], ["intime", "stay_id"])


@query("w3_top_k_per_group", sql([d.SCORED], "SELECT stay_id, index_time, label, prob FROM (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY prob DESC, index_time) AS rn FROM scored) q WHERE rn <= 3", ["prob"], ["label"]))
def w3(spark, sf):
    return head(d.scored(spark, sf), ["stay_id"], [F.col("prob").desc(), F.col("index_time")], 3)


_HEAD_SQL = "SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) q WHERE rn <= {n}"


@query("w4_head_per_group_small", sql([], _HEAD_SQL.format(n=50)))
def w4_small(spark, sf):
    """A small head is cut before the shuffle."""
    o = d.table(spark, sf, "orders")
    return head(o, ["o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50).select("o_orderkey", "o_orderdate")


@query("w4_head_per_group_large", sql([], _HEAD_SQL.format(n=1500)))
def w4_large(spark, sf):
    """A large head of few groups is ranked by buckets, so no group is one task."""
    o = d.table(spark, sf, "orders").withColumn("b", -value_bucket("o_totalprice"))
    return head(o, ["o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 1500, ["b"]).select("o_orderkey", "o_orderdate")


@query("w5_forward_fill", sql([], "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events", ["last_purchase"]))
def w5(spark, sf):
    """Last earlier purchase value of the same entity, however long ago."""
    e = d.table(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return events.last_known(e, ["user_id"], "ts", "event_id", "v", "last_purchase").select("event_id", "last_purchase")


@query("w6_cumulative_counts", sql([d.SCORED], "SELECT score, n_pos, n_neg, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp FROM (SELECT prob AS score, sum(label) AS n_pos, sum(1 - label) AS n_neg FROM scored GROUP BY 1) q WINDOW w AS (ORDER BY score DESC)", ["score"], ["n_pos", "n_neg", "tp", "fp"]))
def w6(spark, sf):
    return evaluate.sweep(d.scored(spark, sf))


@query("w6_running_total_per_group", sql([], "SELECT o_orderkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) / 100.0 AS running FROM orders", ["running"]))
def w6_group(spark, sf):
    """Three huge groups, each summed along its order in buckets."""
    o = d.table(spark, sf, "orders").withColumns({"b": value_bucket("o_totalprice"), "cents": F.round(F.col("o_totalprice") * 100).cast("long")})
    s = running_sums(o.select("o_orderkey", "o_orderstatus", "o_totalprice", "cents", "b"), ["o_orderstatus"], ["b"], [F.col("o_totalprice"), F.col("o_orderkey")], {"running": "cents"})
    return s.select("o_orderkey", (F.col("running") / 100.0).alias("running"))


# -- sorts and limits --------------------------------------------------------------------------------------------


@query("o1_sorted", sql([d.SERIES], "SELECT stay_id, charttime, value FROM series ORDER BY stay_id, charttime", ["value"]))
def o1(spark, sf):
    return d.series(spark, sf).select("stay_id", "charttime", "value").orderBy("stay_id", "charttime")


@query("o2_preview", sql([d.SCORED], "SELECT * FROM scored ORDER BY stay_id, index_time LIMIT 10", ["prob"], ["label"]))
def o2(spark, sf):
    return tables.shaped(d.scored(spark, sf), limit=10, order=["stay_id", "index_time"])


@query("o3_top_n", sql([d.SCORED], "SELECT stay_id, index_time, prob FROM scored ORDER BY prob DESC, stay_id, index_time LIMIT 200", ["prob"]))
def o3(spark, sf):
    return d.scored(spark, sf).orderBy(F.col("prob").desc(), "stay_id", "index_time").limit(200).select("stay_id", "index_time", "prob")


@query("o5_display_order", sql([], "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, 1", ints=["n"]))
def o5(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "5-LOW", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    return d.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(rank, "o_orderpriority")


@query("o6_seeded_sample", sql([d.SCORED], f"SELECT stay_id, index_time FROM scored ORDER BY {d.h60('stay_id', 'epoch_us(index_time)', seed=7)}, stay_id, index_time LIMIT 500"))
def o6(spark, sf):
    s = d.scored(spark, sf).withColumn("us", F.unix_micros("index_time"))
    return quality.hash_sample(s, 500, F.struct(hash60("stay_id", "us", seed=7), "stay_id", "index_time")).select("stay_id", "index_time")


# -- unions ----------------------------------------------------------------------------------------------------------


@query("u1_series_union", sql([d.SERIES], "SELECT variable, count(*) AS n, sum(value) AS total FROM (SELECT * FROM series WHERE variable IN ('click', 'view') UNION ALL SELECT * FROM series WHERE variable IN ('error', 'purchase')) q GROUP BY 1", ["total"], ["n"]))
def u1(spark, sf):
    s = d.series(spark, sf)
    both = extract.series(s.where(F.col("variable").isin("click", "view")), s.where(F.col("variable").isin("error", "purchase")))
    return both.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("u2_horizon_union", sql([*d.TIMELINE, d.LABELS], "SELECT stay_id, index_time, horizon_hours, label FROM labels_all", ints=["horizon_hours", "label"]))
def u2(spark, sf):
    """All horizons from one pass over the grid."""
    return d.labels(spark, sf).select("stay_id", "index_time", "horizon_hours", "label")


@query("u3_union_missing_columns", sql([], "SELECT c_custkey AS k, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part", ["bal"]))
def u3(spark, sf):
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    p = d.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"))
    return extract.series(c, p)


@query("u4_id_union", sql([], "SELECT p_partkey AS itemid FROM part WHERE p_name LIKE '%rod%' UNION SELECT p_partkey FROM part WHERE p_size <= 3"))
def u4(spark, sf):
    p = d.table(spark, sf, "part").withColumnRenamed("p_partkey", "itemid")
    return dictionary.id_union(p.where(F.col("p_name").contains("rod")).select("itemid"), p.where(F.col("p_size") <= 3).select("itemid"))


# -- scalar functions and dictionaries ----------------------------------------------------------------------------------


_BANK_ROWS = "bank AS (SELECT * FROM (VALUES ('plate', 0, 'plate'), ('rod', 1, 'rod'), ('red', 2, 'red'), ('ring', 3, 'ring|bearing')) b(name, bank_order, pattern))"


@query("x1_keyword_items", sql([_BANK_ROWS], "SELECT p_partkey AS itemid, name, bank_order FROM part, bank WHERE regexp_matches(lower(trim(p_name)), pattern)", ints=["bank_order"]))
def x1(spark, sf):
    return dictionary.match_labels(d.part_items(spark, sf), d.BANK)


@query("x1_keyword_items_word", sql([_BANK_ROWS], "SELECT p_partkey AS itemid, name, bank_order FROM part, bank WHERE regexp_matches(lower(trim(p_name)), '\\b(' || pattern || ')\\b')", ints=["bank_order"]))
def x1_word(spark, sf):
    return dictionary.match_labels(d.part_items(spark, sf), d.BANK, mode="word")


@query("x2_pattern_items", sql([], "SELECT p_partkey AS itemid, name FROM (SELECT p_partkey, concat_ws(' | ', p_name, p_brand, p_type) AS t FROM part) q, (VALUES ('metal', '\\bsteel\\b|\\bRod\\b|bolt'), ('brand', 'brand#1[0-9]?\\b')) b(name, pattern) WHERE regexp_matches(t, '(?i)' || pattern)"))
def x2(spark, sf):
    """Case-insensitive patterns over several text columns joined into one line."""
    bank = {"metal": [r"\bsteel\b", r"\bRod\b", "bolt"], "brand": [r"brand#1[0-9]?\b"]}
    return dictionary.match_texts(d.part_items(spark, sf), bank, ["label", "abbreviation", "category"]).select("itemid", "name")


@query("x3_last_variable_wins", sql([_BANK_ROWS], "SELECT p_partkey AS itemid, arg_max(name, bank_order) AS variable FROM part, bank WHERE regexp_matches(lower(trim(p_name)), pattern) GROUP BY 1"))
def x3(spark, sf):
    return dictionary.last_wins(dictionary.match_labels(d.part_items(spark, sf), d.BANK))


@query("x4_hour_rounding", sql([], "SELECT event_id, date_trunc('hour', ts) AS down, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS up FROM events"))
def x4(spark, sf):
    return d.table(spark, sf, "events").select("event_id", timefn.floor_hour("ts").alias("down"), timefn.ceil_hour("ts").alias("up"))


@query("x5_hours_between", sql([d.STAYS], "SELECT e.event_id, (epoch_us(e.ts) - epoch_us(s.icu_in)) / 3.6e9 AS hours FROM events e JOIN stays s ON e.user_id = s.stay_id", ["hours"]))
def x5(spark, sf):
    e = d.table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("stay_id"))
    return events.since(e, d.stays(spark, sf), "stay_id", "ts", "icu_in").select("event_id", "hours")


@query("x6_zone_strip", sql([], "SELECT event_id, ts - INTERVAL 5 HOUR AS t FROM events"))
def x6(spark, sf):
    """Times written with an offset, as UTC wall clock without a zone."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+05:00"))
    return d.table(spark, sf, "events").select("event_id", timefn.naive(text.cast("timestamp")).alias("t"))


@query("x7_number_from_text", sql([], "SELECT o_orderkey, TRY_CAST(regexp_extract(o_orderpriority, '-?[0-9]+[.]?[0-9]*') AS DOUBLE) AS number FROM orders", ["number"]))
def x7(spark, sf):
    return d.table(spark, sf, "orders").select("o_orderkey", parsing.number_in_text("o_orderpriority").alias("number"))


@query("x8_logit_sigmoid", sql([d.SCORED], "SELECT stay_id, index_time, ln(c / (1 - c)) AS z, 1 / (1 + exp(-(0.8 * ln(c / (1 - c)) - 0.3))) AS s FROM (SELECT *, greatest(least(prob, 1 - 1e-6), 1e-6) AS c FROM scored) q", ["z", "s"]))
def x8(spark, sf):
    return d.scored(spark, sf).select("stay_id", "index_time", logit("prob").alias("z"), platt("prob", 0.8, -0.3).alias("s"))


KNOTS = ([0.1, 0.3, 0.3, 0.7], [0.0, 0.2, 0.5, 0.9])


@query("x9_interpolation", sql([d.SCORED], "SELECT stay_id, index_time, CASE WHEN prob <= 0.1 THEN 0.0 WHEN prob < 0.3 THEN (prob - 0.1) / 0.2 * 0.2 WHEN prob < 0.7 THEN 0.5 + (prob - 0.3) * 1.0 ELSE 0.9 END AS y FROM scored", ["y"]))
def x9(spark, sf):
    return d.scored(spark, sf).select("stay_id", "index_time", interpolate("prob", *KNOTS).alias("y"))


@query("x10_clip", sql([], "SELECT c_custkey, greatest(least(c_acctbal, 5000.0), 0.0) AS balance FROM customer", ["balance"]))
def x10(spark, sf):
    return d.table(spark, sf, "customer").select("c_custkey", clip("c_acctbal", 0, 5000).alias("balance"))


@query("x11_feature_groups", sql([], "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'colour' WHEN regexp_matches(p_name, '(rod|bolt)$') THEN 'metal' ELSE 'others' END AS feature_group FROM part"))
def x11(spark, sf):
    p = d.table(spark, sf, "part")
    return p.select("p_partkey", dictionary.group_of(F.col("p_name"), {"colour": "^(red|blue)", "metal": "(rod|bolt)$"}).alias("feature_group"))


@query("x11_default_groups", sql([], "SELECT p_name || '__24h__mean' AS feature, CASE WHEN regexp_matches(p_name, '^(heart_rate|resp_rate|sbp|dbp|mbp|spo2|temperature)') THEN 'vitals' WHEN regexp_matches(p_name, '^(bun|creatinine|hgb|platelet|ca|cl|ph|pt)') THEN 'labs' WHEN regexp_matches(p_name, '^(peep)') THEN 'vent' ELSE 'others' END AS feature_group FROM (SELECT DISTINCT replace(p_name, 'plate', 'platelet') AS p_name FROM part UNION SELECT DISTINCT replace(split_part(p_name, ' ', 2), 'plate', 'platelet') FROM part) q"))
def x11_default(spark, sf):
    """The default groups over feature names made of part names."""
    p = d.table(spark, sf, "part")
    whole = F.replace("p_name", F.lit("plate"), F.lit("platelet"))
    last = F.replace(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("plate"), F.lit("platelet"))
    names = p.select(F.explode(F.array(whole, last)).alias("n")).distinct().select(F.concat("n", F.lit("__24h__mean")).alias("feature"))
    return names.select("feature", dictionary.group_of(F.col("feature"), FEATURE_GROUPS).alias("feature_group"))


@query("x12_canonical_name", sql([], "SELECT p_partkey, CASE WHEN regexp_matches(w, '(?i)^(norepinephrine|noradrenaline|levophed|levo)$') THEN 'norepinephrine' WHEN regexp_matches(w, '(?i)^(epinephrine|adrenaline)$') THEN 'epinephrine' END AS drug FROM (SELECT p_partkey, CASE split_part(p_name, ' ', 2) WHEN 'rod' THEN 'Levophed' WHEN 'bolt' THEN ' ADRENALINE ' WHEN 'gear' THEN 'levo drip' ELSE split_part(p_name, ' ', 2) END AS w0, trim(w0) AS w FROM part) q"))
def x12(spark, sf):
    last = F.split_part("p_name", F.lit(" "), F.lit(2))
    word = F.when(last == "rod", "Levophed").when(last == "bolt", " ADRENALINE ").when(last == "gear", "levo drip").otherwise(last)
    return d.table(spark, sf, "part").select("p_partkey", dictionary.canonical_name(word, DRUG_NAMES).alias("drug"))


@query("x13_manifest")
def x13(spark, sf):
    """Sizes and MD5 sums of report files."""
    rep = d.table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    path = new_path(spark, "release")
    writers.report(rep.orderBy("o_orderstatus", "o_orderpriority"), path, "csv")
    return writers.manifest(spark, path)
