"""Queries over scored tables: metrics, thresholds, calibration, lead time, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scoring import platt
from tidegauge.operators import alerts, calibrate, evaluate, leadtime
from tidegauge.plans import data as d
from tidegauge.plans.catalog import query, sql
from tidegauge.session import materialize
from tidegauge.sources import writers
from tidegauge.streaming import feeds

T = d.THRESHOLD

# Average precision and AUROC by the sweep over distinct scores, per group.
SWEEP = (
    "SELECT {by} score, n_pos, n_neg, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp FROM (SELECT {by} {prob} AS score, "
    "sum({label}) AS n_pos, sum(1 - {label}) AS n_neg FROM {src} GROUP BY {by} {prob}) q WINDOW w AS ({part} ORDER BY score DESC)"
)


def sweep_sql(src="scored", label="label", prob="prob", by=()):
    keys = "".join(f"{b}, " for b in by)
    return SWEEP.format(src=src, label=label, prob=prob, by=keys, part=f"PARTITION BY {', '.join(by)}" if by else "")


def rank_sql(src="scored", label="label", prob="prob", by=()):
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return (
        f"SELECT {keys} sum(n_neg * (tp - n_pos / 2.0)) / nullif(CAST(sum(n_pos) AS DOUBLE) * sum(n_neg), 0) AS auroc, "
        "CASE WHEN sum(n_neg) > 0 THEN sum(n_pos * CAST(tp AS DOUBLE) / (tp + fp)) / nullif(sum(n_pos), 0) END AS ap, "
        "sum(n_pos) + sum(n_neg) AS n, CAST(sum(n_pos) AS DOUBLE) / (sum(n_pos) + sum(n_neg)) AS pos_rate "
        f"FROM ({sweep_sql(src, label, prob, by)}) s{group}"
    )


def confusion_sql(thr, src="scored", label="label", prob="prob", by=""):
    group = f"{by}, " if by else ""
    return (
        f"SELECT {group} count(*) FILTER ({prob} >= {thr} AND {label} = 1) AS TP, count(*) FILTER ({prob} >= {thr} AND {label} <> 1) AS FP, "
        f"count(*) FILTER ({prob} < {thr} AND {label} <> 1) AS TN, count(*) FILTER ({prob} < {thr} AND {label} = 1) AS FN FROM {src}"
        + (f" GROUP BY {by}" if by else "")
    )


PRF = (
    "coalesce(CAST(TP AS DOUBLE) / nullif(TP + FP, 0), 0) AS precision, coalesce(CAST(TP AS DOUBLE) / nullif(TP + FN, 0), 0) AS recall, "
    "coalesce(2.0 * TP / nullif(2 * TP + FP + FN, 0), 0) AS f1, coalesce(CAST(TP + FP AS DOUBLE) / nullif(TP + FP + TN + FN, 0), 0) AS alert_rate"
)
COUNTS = ["TP", "FP", "TN", "FN"]
RATES = ["precision", "recall", "f1", "alert_rate"]


@query("e1_rank_metrics", sql([d.SCORED], rank_sql(), ["auroc", "ap", "pos_rate"], ["n"]))
def e1(spark, sf):
    """AUROC and average precision with ties, from one pass over distinct scores."""
    return evaluate.rank_metrics(d.scored(spark, sf))


@query("e1_rank_metrics_doc_labels", sql(["docs AS (SELECT l.quality AS label, n_chars / (n_chars + 2000.0) AS prob FROM labels l JOIN documents t ON l.doc_id = t.doc_id)"], rank_sql("docs"), ["auroc", "ap", "pos_rate"], ["n"]))
def e1_docs(spark, sf):
    """An imbalanced label with the document length as score."""
    t = d.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("prob"))
    return evaluate.rank_metrics(d.table(spark, sf, "labels").join(t, "doc_id").withColumnRenamed("quality", "label"))


@query("e2_roc_points", sql([d.SCORED], f"SELECT score AS threshold, fp / CAST(sum(n_neg) OVER () AS DOUBLE) AS fpr, tp / CAST(sum(n_pos) OVER () AS DOUBLE) AS tpr FROM ({sweep_sql()}) s UNION ALL SELECT NULL, 0.0, 0.0", ["threshold", "fpr", "tpr"]))
def e2(spark, sf):
    return evaluate.roc(d.scored(spark, sf))


@query(
    "e2_roc_corners",
    sql([d.SCORED],
        "SELECT score AS threshold, fp / CAST(nn AS DOUBLE) AS fpr, tp / CAST(np AS DOUBLE) AS tpr FROM (SELECT *, sum(n_neg) OVER () AS nn, sum(n_pos) OVER () AS np, row_number() OVER (ORDER BY score DESC) AS rn, "
        f"lead(n_pos) OVER (ORDER BY score DESC) AS next_p, lead(n_neg) OVER (ORDER BY score DESC) AS next_n FROM ({sweep_sql()}) s) q "
        "WHERE rn = 1 OR next_p IS NULL OR next_p <> n_pos OR next_n <> n_neg UNION ALL SELECT NULL, 0.0, 0.0", ["threshold", "fpr", "tpr"]),
)
def e2_corners(spark, sf):
    """Without points at which the step stays the same."""
    return evaluate.roc(d.scored(spark, sf), drop_collinear=True)


@query("e3_pr_points", sql([d.SCORED], f"SELECT score AS threshold, tp / CAST(sum(n_pos) OVER () AS DOUBLE) AS recall, tp / CAST(tp + fp AS DOUBLE) AS precision FROM ({sweep_sql()}) s UNION ALL SELECT NULL, 0.0, 1.0", ["threshold", "recall", "precision"]))
def e3(spark, sf):
    return evaluate.pr(d.scored(spark, sf))


@query("e4_confusion", sql([d.SCORED], confusion_sql(T), ints=COUNTS))
def e4(spark, sf):
    return evaluate.confusion(d.scored(spark, sf), T)


@query("e5_precision_recall_f1", sql([d.SCORED], f"SELECT *, {PRF} FROM ({confusion_sql(T)}) c", RATES, COUNTS))
def e5(spark, sf):
    return evaluate.prf(evaluate.confusion(d.scored(spark, sf), T))


def _report_sql(thr: float) -> str:
    odds = "({c} / (1 - {c}))".format(c=f"greatest(least(CAST({thr} AS DOUBLE), 1 - 1e-6), 1e-6)")
    return (
        f"SELECT TP, FP, TN, FN, n AS N, CAST({thr} AS DOUBLE) AS threshold, (TP + FN) / n AS prevalence, TP / greatest(TP + FN, 1e-12) AS sensitivity, TN / greatest(TN + FP, 1e-12) AS specificity, "
        "TP / greatest(TP + FP, 1e-12) AS ppv, TN / greatest(TN + FN, 1e-12) AS npv, (TP + TN) / greatest(TP + FP + TN + FN, 1e-12) AS accuracy, 2.0 * TP / greatest(2 * TP + FP + FN, 1e-12) AS f1, "
        f"100 * (TP / n - FP / n * {odds}) AS net_benefit_per100, 100 * ((TP + FN) / n - (1 - (TP + FN) / n) * {odds}) AS treat_all_per100 "
        f"FROM (SELECT CAST(TP AS DOUBLE) AS TP, CAST(FP AS DOUBLE) AS FP, CAST(TN AS DOUBLE) AS TN, CAST(FN AS DOUBLE) AS FN, CAST(TP + FP + TN + FN AS DOUBLE) AS n FROM ({confusion_sql(thr)}) c) z"
    )


REPORT = ["threshold", "prevalence", "sensitivity", "specificity", "ppv", "npv", "accuracy", "f1", "net_benefit_per100", "treat_all_per100"]


@query("e6_threshold_report", sql([d.SCORED], _report_sql(T), REPORT, [*COUNTS, "N"]))
def e6(spark, sf):
    return evaluate.threshold_report(evaluate.confusion(d.scored(spark, sf), T), T)


@query("e6_threshold_report_extremes", sql([d.SCORED], f"{_report_sql(0.0)} UNION ALL {_report_sql(1.0)}", REPORT, [*COUNTS, "N"]))
def e6_extremes(spark, sf):
    """Thresholds 0 and 1, with scores that are NaN beside the real ones: those are not counted."""
    s = d.scored(spark, sf)
    bad = s.withColumn("prob", F.lit(float("nan")))
    both = s.unionByName(bad)
    return reduce(DataFrame.unionByName, [evaluate.threshold_report(evaluate.confusion(both, t), t) for t in (0.0, 1.0)])


@query("e1_rank_metrics_nan_scores", sql([d.SCORED], rank_sql(), ["auroc", "ap", "pos_rate"], ["n"]))
def e1_nan(spark, sf):
    """Rows whose score is NaN or null change nothing."""
    s = d.scored(spark, sf)
    bad = s.withColumn("prob", F.when(F.col("label") == 1, F.lit(float("nan"))))
    return evaluate.rank_metrics(s.unionByName(bad))


@query("e7_brier", sql([d.SCORED], "SELECT avg(pow(prob - label, 2)) AS brier FROM scored", ["brier"]))
def e7(spark, sf):
    return evaluate.brier(d.scored(spark, sf))


def _bin_sql(edges, prob="prob"):
    k = " + ".join(f"CAST({prob} >= CAST({e!r} AS DOUBLE) AS INT)" for e in edges)
    return f"greatest(least(({k}) - 1, {len(edges) - 2}), 0)"


UNIFORM = _bin_sql(evaluate.uniform_edges())


def ece_sql(src="scored", label="label", prob="prob", bin_=UNIFORM, by=()):
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return (
        f"SELECT {keys} sum(n * abs(a - c)) / sum(n) AS ece FROM (SELECT {keys} {bin_} AS bin, count(*) AS n, avg({label}) AS a, avg({prob}) AS c FROM {src} GROUP BY {keys} {bin_}) q{group}"
    )


@query("e8_ece_uniform", sql([d.SCORED], ece_sql(), ["ece"]))
def e8(spark, sf):
    return evaluate.ece(d.scored(spark, sf))


_QUANTILES = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"


@query(
    "e9_ece_quantile",
    sql(["docs AS (SELECT t.source, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS label, n_chars / 200000.0 AS prob FROM documents t LEFT JOIN labels l ON l.doc_id = t.doc_id)",
         f"edges AS (SELECT list_sort(list_distinct(quantile_cont(prob, {_QUANTILES}))) AS e FROM docs)",
         f"used AS (SELECT CASE WHEN len(e) < 11 THEN {[x for x in evaluate.uniform_edges(10)]!r} ELSE e END AS e FROM edges)",
         "binned AS (SELECT label, prob, greatest(least((SELECT count(*) FROM unnest(e) u(x) WHERE x <= prob) - 1, len(e) - 2), 0) AS bin FROM docs, used)"],
        ece_sql("binned", bin_="bin"), ["ece"]),
)
def e9(spark, sf):
    """Edges are the score's own deciles."""
    t = d.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 200000.0).alias("prob"))
    y = d.table(spark, sf, "labels").select("doc_id", "quality")
    docs = t.join(y, "doc_id", "left").withColumn("label", F.coalesce(F.col("quality"), F.lit(0)))
    return evaluate.ece(docs, bins=10, strategy="quantile")


@query("e9_ece_quantile_fallback", sql([d.SCORED], ece_sql(bin_=_bin_sql(evaluate.uniform_edges(100))), ["ece"]))
def e9_fallback(spark, sf):
    """100 quantile edges over 60 distinct scores are not distinct, so uniform edges are used."""
    return evaluate.ece(d.scored(spark, sf), bins=100, strategy="quantile")


@query("e10_reliability", sql([d.SCORED], f"SELECT {UNIFORM} AS bin, avg(prob) AS prob_pred, avg(label) AS prob_true, count(*) AS n FROM scored GROUP BY {UNIFORM}", ["prob_pred", "prob_true"], ["bin", "n"]))
def e10(spark, sf):
    return evaluate.reliability(d.scored(spark, sf))


EVALUATION = (
    "SELECT r.auroc, r.ap, r.n, r.pos_rate, b.brier, c.ece FROM ({rank}) r, (SELECT avg(pow(prob - label, 2)) AS brier FROM {src}) b, ({ece}) c"
)


@query(
    "e11_window_and_entity_level",
    sql([d.SCORED, d.POOLED],
        "SELECT 'window' AS level, * FROM (" + EVALUATION.format(rank=rank_sql(), src="scored", ece=ece_sql()) + ") a UNION ALL "
        "SELECT 'entity' AS level, * FROM (" + EVALUATION.format(rank=rank_sql("pooled"), src="pooled", ece=ece_sql("pooled")) + ") b",
        ["auroc", "ap", "pos_rate", "brier", "ece"], ["n"]),
)
def e11(spark, sf):
    s = materialize(d.scored(spark, sf), "scored")
    a = evaluate.evaluate(s).withColumn("level", F.lit("window"))
    return a.unionByName(evaluate.evaluate(evaluate.pool(s)).withColumn("level", F.lit("entity")))


def dca_sql(src="scored", prob="prob", weight="1", by="", n="count(*)"):
    keys = f"s.{by}, " if by else ""
    ts = ", ".join(f"CAST({t!r} AS DOUBLE)" for t in evaluate.DCA_THRESHOLDS)
    return (
        f"SELECT {keys.replace('s.', '')} threshold, (tp / w - fp / w * threshold / (1 - threshold)) * 100 AS nb_model, (p / w - (1 - p / w) * threshold / (1 - threshold)) * 100 AS nb_treat_all, "
        f"0.0 AS nb_treat_none, p / w * 100 AS prevalence, n FROM (SELECT {keys} threshold, CAST(sum(CASE WHEN {prob} >= threshold AND label = 1 THEN {weight} ELSE 0 END) AS DOUBLE) AS tp, "
        f"CAST(sum(CASE WHEN {prob} >= threshold AND label <> 1 THEN {weight} ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END) AS DOUBLE) AS p, "
        f"CAST(sum({weight}) AS DOUBLE) AS w, {n} AS n FROM {src} s, (SELECT unnest([{ts}]) AS threshold) t GROUP BY {keys} threshold) q"
    )


_DCA = ["threshold", "nb_model", "nb_treat_all", "nb_treat_none", "prevalence"]


@query("e12_decision_curve", sql([d.SCORED], dca_sql(), _DCA, ["n"]))
def e12(spark, sf):
    """Net benefit at 99 thresholds from one pass."""
    return evaluate.decision_curve(d.scored(spark, sf))


@query("e12_decision_curve_weighted", sql(["weighted AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount * 5 AS prob, l_quantity AS wt FROM lineitem)"], dca_sql("weighted", weight="wt", n="round(sum(wt))"), _DCA, ["n"]))
def e12_weighted(spark, sf):
    li = d.table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 5).alias("prob"), F.col("l_quantity").alias("wt"))
    return evaluate.decision_curve(li, weight="wt")


def alert_table_sql(src="scored", by=""):
    keys = f"s.{by}, " if by else ""
    ts = ", ".join(f"CAST({t!r} AS DOUBLE)" for t in evaluate.ALERT_THRESHOLDS)
    return (
        f"SELECT *, {PRF} FROM (SELECT {keys} threshold, count(*) FILTER (prob >= threshold AND label = 1) AS TP, count(*) FILTER (prob >= threshold AND label <> 1) AS FP, "
        f"count(*) FILTER (prob < threshold AND label <> 1) AS TN, count(*) FILTER (prob < threshold AND label = 1) AS FN FROM {src} s, (SELECT unnest([{ts}]) AS threshold) t GROUP BY {keys} threshold) q"
    )


@query("e13_alert_table", sql([d.SCORED], alert_table_sql(), ["threshold", *RATES], COUNTS))
def e13(spark, sf):
    return evaluate.alert_table(d.scored(spark, sf))


@query("e14_threshold_for_rate", sql([d.SCORED, d.POOLED], "SELECT 'window' AS level, quantile_cont(prob, 0.9) AS threshold FROM scored UNION ALL SELECT 'entity', quantile_cont(prob, 0.9) FROM pooled UNION ALL SELECT 'none', 1.0 UNION ALL SELECT 'all', 0.0", ["threshold"]))
def e14(spark, sf):
    """The score reached by a tenth of windows, and of entities; rates of 0 and 1 are fixed."""
    s = d.scored(spark, sf)
    out = evaluate.threshold_for_rate(s, 0.1).withColumn("level", F.lit("window"))
    out = out.unionByName(evaluate.threshold_for_rate(evaluate.pool(s), 0.1).withColumn("level", F.lit("entity")))
    out = out.unionByName(evaluate.threshold_for_rate(s, 0.0).withColumn("level", F.lit("none")))
    return out.unionByName(evaluate.threshold_for_rate(s, 1.0).withColumn("level", F.lit("all")))


SWEEP_RATES = [0.02 + 0.01 * i for i in range(19)]
_RATE_ROWS = ", ".join(f"(CAST({r!r} AS DOUBLE), CAST({1.0 - r!r} AS DOUBLE))" for r in SWEEP_RATES)
RATE_SWEEP = (
    "rate_thr AS (" + " UNION ALL ".join(f"SELECT CAST({r!r} AS DOUBLE) AS target_rate, quantile_cont(prob, {1.0 - r!r}) AS threshold FROM pooled" for r in SWEEP_RATES) + ")",
    "rate_counts AS (SELECT target_rate, threshold, count(*) FILTER (prob >= threshold AND label = 1) AS TP, count(*) FILTER (prob >= threshold AND label <> 1) AS FP, "
    "count(*) FILTER (prob < threshold AND label <> 1) AS TN, count(*) FILTER (prob < threshold AND label = 1) AS FN FROM pooled, rate_thr GROUP BY 1, 2)",
    f"rate_sweep AS (SELECT *, {PRF} FROM rate_counts)",
)


@query("e15_rate_sweep", sql([d.SCORED, d.POOLED, *RATE_SWEEP], "SELECT * FROM rate_sweep", ["target_rate", "threshold", *RATES], COUNTS))
def e15(spark, sf):
    """Entity metrics at the thresholds of alert rates 2 to 20 percent."""
    return evaluate.sweep_rates(evaluate.pool(d.scored(spark, sf)), SWEEP_RATES)


PROFILE_SQL = (
    "SELECT target, threshold, alert_rate, precision, recall, f1 FROM (SELECT t.target, s.*, row_number() OVER (PARTITION BY t.target ORDER BY round(abs(s.alert_rate - t.target), 12), s.precision DESC, s.threshold) AS rn "
    "FROM rate_sweep s, (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.15)) t(target)) q WHERE rn = 1"
)


@query("e16_threshold_profiles", sql([d.SCORED, d.POOLED, *RATE_SWEEP], PROFILE_SQL, ["target", "threshold", "alert_rate", "precision", "recall", "f1"]))
def e16(spark, sf):
    return evaluate.profiles(evaluate.sweep_rates(evaluate.pool(d.scored(spark, sf)), SWEEP_RATES), [0.05, 0.10, 0.15])


@query("o4_nearest_then_best", sql([], "SELECT target, n_name FROM (SELECT t.target, n_name, row_number() OVER (PARTITION BY target ORDER BY abs(s.bal - t.target), -s.n, n_name) AS rn FROM (SELECT n_name, avg(s_acctbal) AS bal, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) s, (VALUES (2000), (4000), (6000)) t(target)) q WHERE rn = 1", ints=["target"]))
def o4(spark, sf):
    """The nation whose mean balance is nearest to each target."""
    s = d.table(spark, sf, "supplier").join(d.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    per = s.groupBy("n_name").agg(F.avg("s_acctbal").alias("bal"), F.count(F.lit(1)).alias("n"))
    each = per.withColumn("target", F.explode(F.array(F.lit(2000), F.lit(4000), F.lit(6000))))
    best = F.min_by("n_name", F.struct(F.abs(F.col("bal") - F.col("target")), -F.col("n"), F.col("n_name")))
    return each.groupBy("target").agg(best.alias("n_name"))


@query("j14_grid_of_thresholds", sql([d.SCORED], "SELECT year(index_time) AS y, threshold, count(*) FILTER (prob >= threshold AND label = 1) AS TP, count(*) FILTER (prob >= threshold AND label <> 1) AS FP, count(*) FILTER (prob < threshold AND label <> 1) AS TN, count(*) FILTER (prob < threshold AND label = 1) AS FN FROM scored, (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS threshold) t GROUP BY 1, 2", ["threshold"], ["y", *COUNTS]))
def j14(spark, sf):
    """A table at each of several thresholds, per year: bucketed once instead of multiplied."""
    s = d.scored(spark, sf).withColumn("y", F.year("index_time"))
    return evaluate.threshold_counts(s, [0.2, 0.4, 0.6, 0.8], by=["y"]).drop("__rows")


# -- lead time -------------------------------------------------------------------------------------------------

LEADS = (
    f"leads AS (SELECT *, (epoch_us(first_event_time) - epoch_us(first_alert_time)) / 3.6e9 AS lead_hours FROM (SELECT stay_id, max(label) AS stay_label, max(prob) AS max_prob, "
    f"min(index_time) FILTER (prob >= {T}) AS first_alert_time, CASE WHEN max(prob) >= {T} THEN 1 ELSE 0 END AS stay_pred, max(first_event_time) AS first_event_time FROM scored_event GROUP BY 1) q)"
)
LEAD_PARTS = [d.SCORED, d.SCORED_EVENT, LEADS]
LEAD_STATS = "count(lead_hours) AS n, avg(lead_hours) AS mean, stddev_samp(lead_hours) AS std, min(lead_hours) AS min, max(lead_hours) AS max, " + ", ".join(
    f"quantile_cont(lead_hours, {q}) AS {n}" for n, q in (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9))
)
_LEAD = ["mean", "std", "min", "max", "p10", "p25", "p50", "p75", "p90"]


def _leads(spark, sf, positives=True):
    return leadtime.lead_times(d.scored(spark, sf), T, positives=positives, events=d.event_times(spark, sf))


@query("e17_lead_time_detail", sql(LEAD_PARTS, "SELECT stay_id, first_event_time, first_alert_time, lead_hours FROM leads WHERE stay_label = 1", ["lead_hours"]))
def e17(spark, sf):
    return _leads(spark, sf).select("stay_id", "first_event_time", "first_alert_time", "lead_hours")


@query("e17_lead_time_stats", sql(LEAD_PARTS, f"SELECT {LEAD_STATS} FROM leads WHERE stay_label = 1", _LEAD, ["n"]))
def e17_stats(spark, sf):
    return leadtime.stats(_leads(spark, sf))


@query("e18_lead_time_rules", sql(LEAD_PARTS, f"SELECT 'positive' AS rule, {LEAD_STATS} FROM leads WHERE stay_label = 1 AND lead_hours > 0 UNION ALL SELECT 'nonnegative', {LEAD_STATS} FROM leads WHERE stay_pred = 1 AND lead_hours >= 0", _LEAD, ["n"]))
def e18(spark, sf):
    a = leadtime.stats(leadtime.keep(_leads(spark, sf), "positive")).withColumn("rule", F.lit("positive"))
    b = leadtime.stats(leadtime.keep(_leads(spark, sf, False), "nonnegative")).withColumn("rule", F.lit("nonnegative"))
    return a.unionByName(b)


POSITIVE_LEADS = "pl AS (SELECT lead_hours FROM leads WHERE stay_label = 1 AND lead_hours > 0)"


@query("e19_lead_histogram", sql([*LEAD_PARTS, POSITIVE_LEADS], "SELECT least(floor((lead_hours - lo) / (hi - lo) * 24), 23) AS bin, count(*) AS n FROM pl, (SELECT min(lead_hours) AS lo, max(lead_hours) AS hi FROM pl) r GROUP BY 1", ints=["bin", "n"]))
def e19(spark, sf):
    return leadtime.histogram(leadtime.keep(_leads(spark, sf), "positive"), "lead_hours")


@query(
    "e19_lead_box",
    sql([*LEAD_PARTS, POSITIVE_LEADS],
        "SELECT q1, median, q3, min(lead_hours) FILTER (lead_hours BETWEEN lo AND hi) AS whisker_low, max(lead_hours) FILTER (lead_hours BETWEEN lo AND hi) AS whisker_high, "
        "count(*) FILTER (NOT lead_hours BETWEEN lo AND hi) AS n_outliers FROM pl, (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
        "(SELECT quantile_cont(lead_hours, 0.25) AS q1, quantile_cont(lead_hours, 0.5) AS median, quantile_cont(lead_hours, 0.75) AS q3 FROM pl) x) y GROUP BY q1, median, q3",
        ["q1", "median", "q3", "whisker_low", "whisker_high"], ["n_outliers"]),
)
def e19_box(spark, sf):
    return leadtime.box(leadtime.keep(_leads(spark, sf), "positive"), "lead_hours")


@query("e19_confidence_histogram", sql([d.SCORED], f"SELECT {UNIFORM} AS bin, count(*) AS n FROM scored GROUP BY 1", ints=["bin", "n"]))
def e19_confidence(spark, sf):
    return d.scored(spark, sf).groupBy(evaluate.uniform_bin("prob").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_TYPE = "CASE WHEN stay_label = 1 AND stay_pred = 1 THEN 'TP' WHEN stay_label <> 1 AND stay_pred = 1 THEN 'FP' WHEN stay_label <> 1 THEN 'TN' ELSE 'FN' END"


@query("e20_error_types", sql([d.SCORED, d.STAY_ALERTS], f"SELECT stay_id, max_prob, stay_label, stay_pred, {_TYPE} AS type FROM stay_alerts", ["max_prob"], ["stay_label", "stay_pred"]))
def e20(spark, sf):
    return evaluate.error_tables(evaluate.entity_alerts(d.scored(spark, sf), T)).select("stay_id", "max_prob", "stay_label", "stay_pred", "type")


@query(
    "e20_error_windows",
    sql([d.SCORED, d.STAY_ALERTS],
        "SELECT stay_id, index_time, label, prob, type FROM (SELECT s.*, a.type, row_number() OVER (PARTITION BY s.stay_id ORDER BY prob DESC, index_time) AS rn FROM scored s "
        f"JOIN (SELECT stay_id, {_TYPE} AS type FROM stay_alerts) a ON s.stay_id = a.stay_id WHERE a.type IN ('FP', 'FN')) q WHERE rn <= 3", ["prob"], ["label"]),
)
def e20_windows(spark, sf):
    """The three highest windows of every wrongly judged entity."""
    s = d.scored(spark, sf)
    return evaluate.error_windows(s, evaluate.entity_alerts(s, T))


@query("e21_threshold_lookup", sql([d.SCORED], "SELECT 'stored' AS kind, quantile_cont(prob, 0.9) AS threshold FROM scored UNION ALL SELECT 'manual', 0.3 UNION ALL SELECT 'demo', 0.1", ["threshold"]))
def e21(spark, sf):
    """A stored threshold comes before a manual one, and that before the demonstration one."""
    fitted = evaluate.threshold_for_rate(d.scored(spark, sf), 0.1)
    params = fitted.select(F.lit("chosen_threshold_val").alias("key"), F.col("threshold").cast("string").alias("value"))
    empty = writers.settings(spark, {"horizon_hours": 24}, "r").select("key", "value")
    names = ["chosen_threshold_val", "chosen_threshold", "best_threshold", "threshold"]
    out = evaluate.chosen_threshold(params, names, 0.3, 0.1).withColumn("kind", F.lit("stored"))
    out = out.unionByName(evaluate.chosen_threshold(empty, names, 0.3, 0.1).withColumn("kind", F.lit("manual")))
    return out.unionByName(evaluate.chosen_threshold(empty, names, None, 0.1).withColumn("kind", F.lit("demo")))


_BY = ["horizon", "split", "method"]


@query(
    "e22_summary_by_split",
    sql([d.SCORED, *d.SPLITS],
        "SELECT r.*, b.brier, c.ece FROM (" + rank_sql("splits", by=_BY) + ") r JOIN (SELECT horizon, split, method, avg(pow(prob - label, 2)) AS brier FROM splits GROUP BY ALL) b USING (horizon, split, method) "
        "JOIN (" + ece_sql("splits", by=_BY) + ") c USING (horizon, split, method)",
        ["auroc", "ap", "pos_rate", "brier", "ece"], ["horizon", "n"]),
)
def e22(spark, sf):
    """All metrics of several horizons, splits and methods at once."""
    return evaluate.evaluate(materialize(d.scored_splits(spark, sf), "scored"), by=_BY)


@query("e22_decision_curves_by_split", sql([d.SCORED, *d.SPLITS, "tagged AS (SELECT *, concat_ws('/', horizon, split, method) AS cell FROM splits)"], dca_sql("tagged", by="cell"), _DCA, ["n"]))
def e22_dca(spark, sf):
    s = d.scored_splits(spark, sf).withColumn("cell", F.concat_ws("/", F.col("horizon").cast("string"), "split", "method"))
    return evaluate.decision_curve(s, by=["cell"])


# -- calibration with a given map ---------------------------------------------------------------------------------

CALIBRATED = "calibrated AS (SELECT s.*, 1 / (1 + exp(-(0.8 * ln(c / (1 - c)) - 0.3))) AS prob_cal FROM (SELECT *, greatest(least(prob, 1 - 1e-6), 1e-6) AS c FROM raw_splits) s)"
TALL = "tall AS (SELECT split, label, 'before' AS stage, prob FROM calibrated UNION ALL SELECT split, label, 'after', prob_cal FROM calibrated)"


@query(
    "c3_before_after",
    sql([d.SCORED, d.SPLITS[0], CALIBRATED, TALL],
        "SELECT r.*, b.brier, c.ece FROM (" + rank_sql("tall", by=["split", "stage"]) + ") r JOIN (SELECT split, stage, avg(pow(prob - label, 2)) AS brier FROM tall GROUP BY ALL) b USING (split, stage) "
        "JOIN (" + ece_sql("tall", by=["split", "stage"]) + ") c USING (split, stage)",
        ["auroc", "ap", "pos_rate", "brier", "ece"], ["n"]),
)
def c3(spark, sf):
    """Metrics of raw and calibrated scores per split, for a given sigmoid map."""
    s = d.scored_splits(spark, sf).where(F.col("method") == "raw").withColumn("prob_cal", platt("prob", 0.8, -0.3))
    return calibrate.before_after(s, ["split"])


@query("c4_threshold_refit", sql([d.SCORED, d.SPLITS[0], CALIBRATED], "SELECT quantile_cont(prob_cal, 0.9) AS threshold FROM calibrated WHERE split = 'val'", ["threshold"]))
def c4(spark, sf):
    s = d.scored_splits(spark, sf).where((F.col("method") == "raw") & (F.col("split") == "val"))
    return evaluate.threshold_for_rate(s.withColumn("prob_cal", platt("prob", 0.8, -0.3)), 0.1, "prob_cal")


# -- alerts -----------------------------------------------------------------------------------------------------------


@query("l1_batch_alerts", sql([d.SCORED, d.STAY_ALERTS], "SELECT stay_id, max_prob, first_alert_time, stay_pred FROM stay_alerts", ["max_prob"], ["stay_pred"]))
def l1(spark, sf):
    return alerts.batch(d.scored(spark, sf), T)


CAP_SQL = "SELECT stay_id, max_prob, first_alert_time, stay_pred FROM (SELECT *, row_number() OVER (PARTITION BY CAST(first_alert_time AS DATE) ORDER BY first_alert_time, stay_id) AS rn FROM stay_alerts WHERE first_alert_time IS NOT NULL) q WHERE rn <= {cap}"


@query("l2_daily_cap", sql([d.SCORED, d.STAY_ALERTS], CAP_SQL.format(cap=2), ["max_prob"], ["stay_pred"]))
def l2(spark, sf):
    return alerts.batch(d.scored(spark, sf), T, daily_cap=2)


@query("l2_daily_cap_high", sql([d.SCORED, d.STAY_ALERTS], CAP_SQL.format(cap=5000), ["max_prob"], ["stay_pred"]))
def l2_high(spark, sf):
    """A cap too large to prune before the shuffle is ranked by minutes."""
    return alerts.batch(d.scored(spark, sf), T, daily_cap=5000)


WEEKLY = [
    d.SCORED, d.SCORED_EVENT,
    "weeks AS (SELECT *, date_trunc('week', index_time) AS week FROM scored_event)",
    f"wstays AS (SELECT week, stay_id, max(label) AS stay_label, max(prob) AS max_prob, min(index_time) FILTER (prob >= {T}) AS first_alert_time, max(first_event_time) AS first_event_time FROM weeks GROUP BY 1, 2)",
    "wlead AS (SELECT week, (epoch_us(first_event_time) - epoch_us(first_alert_time)) / 3.6e9 AS lead FROM wstays)",
    "wstat AS (SELECT week, count(*) AS lead_n, avg(lead) AS lead_mean, quantile_cont(lead, 0.5) AS lead_p50 FROM wlead WHERE lead >= 0 GROUP BY 1)",
]


@query(
    "l3_weekly_monitor",
    sql(WEEKLY,
        f"SELECT c.*, {PRF}, r.auroc, r.ap, coalesce(l.lead_n, 0) AS lead_n, l.lead_mean, l.lead_p50 FROM ({confusion_sql(T, 'wstays', 'stay_label', 'max_prob', 'week')}) c "
        f"LEFT JOIN ({rank_sql('weeks', by=['week'])}) r ON c.week = r.week LEFT JOIN wstat l ON c.week = l.week",
        [*RATES, "auroc", "ap", "lead_mean", "lead_p50"], [*COUNTS, "lead_n"]),
)
def l3(spark, sf):
    """Window and entity metrics and lead times per week."""
    return alerts.weekly(materialize(d.scored(spark, sf), "scored"), T, events=d.event_times(spark, sf))


@query("l4_entity_detail", sql([d.SCORED, d.STAY_ALERTS], "SELECT stay_id, stay_label, max_prob, first_alert_time, stay_pred FROM stay_alerts", ["max_prob"], ["stay_label", "stay_pred"]))
def l4(spark, sf):
    return alerts.entity_detail(d.scored(spark, sf), T)[0]


@query("l4_entity_metrics", sql([d.SCORED, d.STAY_ALERTS], f"SELECT *, {PRF} FROM ({confusion_sql(T, 'stay_alerts', 'stay_label', 'max_prob')}) c", RATES, COUNTS))
def l4_metrics(spark, sf):
    return alerts.entity_detail(d.scored(spark, sf), T)[1]


# A recursive walk over each entity's hits: the next alert is the first hit at least R hours after the last.
HITS = "hits AS (SELECT DISTINCT user_id AS stay_id, ts AS t FROM events WHERE value >= 30)"
REFRACTORY = (
    "WITH RECURSIVE " + HITS + ", kept AS (SELECT stay_id, min(t) AS t FROM hits GROUP BY 1 UNION ALL "
    "SELECT k.stay_id, (SELECT min(h.t) FROM hits h WHERE h.stay_id = k.stay_id AND h.t >= k.t + INTERVAL 24 HOUR) AS t FROM kept k "
    "WHERE EXISTS (SELECT 1 FROM hits h WHERE h.stay_id = k.stay_id AND h.t >= k.t + INTERVAL 24 HOUR)) SELECT stay_id, t AS alert_time FROM kept"
)


def _event_scores(df):
    return df.select(F.col("user_id").alias("stay_id"), F.col("ts").alias("index_time"), F.col("value").alias("prob"))


@query("t1_refractory_alerts", REFRACTORY)
def t1(spark, sf):
    """After an alert, a day of silence for the same entity."""
    return alerts.suppress(_event_scores(d.table(spark, sf, "events")), 30.0, 24)


EVENT_STREAM = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event_stream(spark, sf):
    s = feeds.read_stream(spark, sf, EVENT_STREAM, "events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("t2_streaming_alerts", f"SELECT * FROM ({REFRACTORY}) r WHERE alert_time <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)")
def t2(spark, sf):
    """The same as a stream of several triggers with rows out of order; what the watermark has not passed is still open."""
    rows = d.table(spark, sf, "events").select("user_id", "ts", "value")
    folder = feeds.arriving(rows, "ts")
    s = feeds.read_stream(spark, folder, "user_id long, ts timestamp, value double", files_per_trigger=1)
    return feeds.drain(feeds.alert_feed(_event_scores(s), 30.0, 24), "alerts")


@query(
    "t3_streaming_hourly_mean",
    sql([], "SELECT user_id, event_type, date_trunc('hour', ts) AS hour, avg(value) AS mean, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2, 3", ["mean"], ["n"]),
)
def t3(spark, sf):
    """Hourly means as a stream; hours the watermark has not passed are still open."""
    return feeds.drain(feeds.hourly_means(_event_stream(spark, sf), "user_id", "ts", "event_type", "value"), "hourly")
