"""Metric definitions, edges and invariants against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.scoring import interpolate, logit, platt
from tidegauge.operators import calibrate, evaluate, leadtime


def frame(spark, y, p, **extra):
    return spark.createDataFrame(pd.DataFrame({"label": np.asarray(y, int), "prob": np.asarray(p, float), **extra}))


def auc_by_pairs(y, p):
    pos, neg = p[y == 1], p[y == 0]
    diff = pos[:, None] - neg[None, :]
    return (diff > 0).mean() + 0.5 * (diff == 0).mean()


def ap_by_definition(y, p):
    total, prev = 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        hit = p >= s
        recall = (hit & (y == 1)).sum() / (y == 1).sum()
        total += (recall - prev) * (hit & (y == 1)).sum() / hit.sum()
        prev = recall
    return total


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p * 0.6).astype(int)
    return y, p


def test_auc_and_ap_equal_their_definitions(spark, data):
    y, p = data
    r = evaluate.rank_metrics(frame(spark, y, p)).first()
    assert r["auroc"] == pytest.approx(auc_by_pairs(y, p), abs=1e-12)
    assert r["ap"] == pytest.approx(ap_by_definition(y, p), abs=1e-12)


def test_auc_does_not_change_under_monotone_maps(spark, data):
    y, p = data
    df = frame(spark, y, p).withColumn("sq", F.pow("prob", 3) + 5)
    a = evaluate.rank_metrics(df).first()["auroc"]
    assert evaluate.rank_metrics(df, prob="sq").first()["auroc"] == pytest.approx(a, abs=1e-12)


def test_one_class_gives_null(spark):
    r = evaluate.rank_metrics(frame(spark, [1, 1], [0.2, 0.4])).first()
    assert r["auroc"] is None and r["ap"] is None


def test_ties_across_classes_count_half(spark):
    assert evaluate.rank_metrics(frame(spark, [1, 0], [0.5, 0.5])).first()["auroc"] == 0.5


def test_groups_are_apart(spark, data):
    y, p = data
    df = frame(spark, np.r_[y, 1 - y], np.r_[p, p], g=["a"] * 400 + ["b"] * 400)
    got = {r["g"]: r["auroc"] for r in evaluate.rank_metrics(df, by=["g"]).collect()}
    assert got["a"] == pytest.approx(1 - got["b"], abs=1e-12)


def test_bins_on_edges(spark):
    edges = evaluate.uniform_edges()
    p = [0.0, 0.15, 0.30, 0.35, 0.60, 0.70, 0.85, 0.05, 1.0, *edges]
    want = np.clip(np.digitize(p, np.linspace(0, 1, 21)) - 1, 0, 19)
    got = frame(spark, [0] * len(p), p).withColumn("b", evaluate.uniform_bin()).toPandas().b
    assert (got.to_numpy() == want).all()


def ece_by_definition(y, p, edges):
    b = np.clip(np.digitize(p, edges) - 1, 0, len(edges) - 2)
    return sum(abs(y[b == k].mean() - p[b == k].mean()) * (b == k).mean() for k in set(b))


def test_ece_uniform_quantile_and_fallback(spark, data):
    y, p = data
    df = frame(spark, y, p)
    assert evaluate.ece(df).first()["ece"] == pytest.approx(ece_by_definition(y, p, np.linspace(0, 1, 21)))
    assert evaluate.calibration_summary(df).first()["ece"] == pytest.approx(ece_by_definition(y, p, np.linspace(0, 1, 21)))
    edges = np.unique(np.quantile(p, np.linspace(0, 1, 6)))
    assert evaluate.ece(df, bins=5, strategy="quantile").first()["ece"] == pytest.approx(ece_by_definition(y, p, edges))
    few = np.array([0.2, 0.2, 0.2, 0.8])
    fallback = evaluate.ece(frame(spark, [0, 1, 0, 1], few), bins=10, strategy="quantile").first()["ece"]
    assert fallback == pytest.approx(ece_by_definition(np.array([0, 1, 0, 1]), few, np.linspace(0, 1, 11)))


def test_counts_add_up_and_treat_all_is_closed_form(spark, data):
    y, p = data
    rows = evaluate.threshold_counts(frame(spark, y, p), evaluate.DCA_THRESHOLDS).collect()
    assert len(rows) == 99 and all(r["TP"] + r["FP"] + r["TN"] + r["FN"] == 400 for r in rows)
    prev = y.mean()
    for r in evaluate.decision_curve(frame(spark, y, p), [0.0, 0.25, 0.5, 1.0]).collect():
        t = r["threshold"]
        hit = p >= t
        nb = (hit & (y == 1)).mean() - (hit & (y == 0)).mean() * t / (1 - t)
        assert t in (0.25, 0.5)
        assert r["nb_treat_all"] == pytest.approx(100 * (prev - (1 - prev) * t / (1 - t)))
        assert r["nb_model"] == pytest.approx(100 * nb) and r["n"] == 400


def test_undefined_ratios_are_zero(spark):
    r = evaluate.prf(evaluate.confusion(frame(spark, [0, 0], [0.1, 0.2]), 0.5)).first()
    assert (r["precision"], r["recall"], r["f1"], r["alert_rate"]) == (0.0, 0.0, 0.0, 0.0)


def test_rate_thresholds(spark, data):
    y, p = data
    df = frame(spark, y, p)
    assert evaluate.threshold_for_rate(df, 0.1).first()["threshold"] == pytest.approx(np.quantile(p, 0.9))
    assert evaluate.threshold_for_rate(df, 0.0).first()["threshold"] == 1.0
    assert evaluate.threshold_for_rate(df, 1.0).first()["threshold"] == 0.0
    by = df.withColumn("g", F.lit("x"))
    swept = evaluate.sweep_rates(by, [0.1, 0.3], by=["g"]).collect()
    for r in swept:
        assert r["alert_rate"] == pytest.approx((p >= r["threshold"]).mean())


@pytest.mark.parametrize("few", [64, 0])
def test_groups_by_list_and_by_join(spark, data, few, monkeypatch):
    """Every group is judged by its own thresholds and edges, one with most rows too; a null group has no row."""
    monkeypatch.setattr(evaluate, "FEW_GROUPS", few)
    y, p = data
    group = np.where(np.arange(len(y)) % 10 < 8, "hot", "rest")
    rows = [(int(a), float(b), str(g), 1) for a, b, g in zip(y, p, group)] + [(1, 0.5, None, 1)]
    df = spark.createDataFrame(rows, "label int, prob double, g string, h int")
    swept = evaluate.sweep_rates(df, [0.1, 0.3], by=["g", "h"]).collect()
    assert {r["g"] for r in swept} == {"hot", "rest"} and len(swept) == 4
    for r in swept:
        own = group == r["g"]
        assert r["alert_rate"] == pytest.approx((p[own] >= r["threshold"]).mean())
        assert r["TP"] == int(((p >= r["threshold"]) & (y == 1) & own).sum())
    eces = {r["g"]: r["ece"] for r in evaluate.ece(df, by=["g", "h"], bins=5, strategy="quantile").collect()}
    for g in ("hot", "rest"):
        own = group == g
        assert eces[g] == pytest.approx(ece_by_definition(y[own], p[own], np.unique(np.quantile(p[own], np.linspace(0, 1, 6)))))


def test_few_groups_move_no_rows(spark, data):
    """Bins of few groups: the rows meet their edges without a join."""
    y, p = data
    df = spark.createDataFrame([(int(a), float(b), "x") for a, b in zip(y, p)], "label int, prob double, g string")
    plan = evaluate.with_quantile_bins(df, "prob", ["g"], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and ":" not in line.split("Join")[0]]


def test_missing_scores(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 0, 0.4), (2, 1, None)], "stay_id long, label int, prob double")
    assert {(r["stay_id"], r["prob"]) for r in evaluate.pool(df, missing="zero").collect()} == {(1, 0.4), (2, 0.0)}
    assert {(r["stay_id"], r["label"]) for r in evaluate.pool(df).collect()} == {(1, 0)}


def test_closed_form_maps(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (1.0,), (None,)], "prob double")
    r = [x[0] for x in df.select(logit("prob")).collect()]
    assert r[0] == pytest.approx(np.log(1e-6 / (1 - 1e-6))) and r[2] == pytest.approx(-r[0]) and r[3] is None
    assert df.select(platt("prob", 1, 0)).collect()[1][0] == pytest.approx(0.25)
    xs, ys = [0.1, 0.3, 0.7], [0.0, 0.5, 0.9]
    got = spark.createDataFrame([(float(v),) for v in np.linspace(0, 1, 21)], "v double").select("v", interpolate("v", xs, ys).alias("y")).toPandas()
    assert np.allclose(got.y, np.interp(got.v, xs, ys))


def pav(x, y):
    """Plain pool-adjacent-violators over distinct x."""
    g = pd.DataFrame({"x": x, "y": y}).groupby("x").y.agg(["mean", "size"]).reset_index()
    blocks = []
    for m, w, v in zip(g["mean"], g["size"], g["x"]):
        blocks.append([m, w, [v]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[2] += b[2]
    return {v: b[0] for b in blocks for v in b[2]}


def test_isotonic_equals_pooling(spark, data):
    y, p = data
    df = frame(spark, y, p)
    got = calibrate.apply(calibrate.fit(df, "isotonic"), df).toPandas()
    want = pav(p, y)
    assert np.allclose(got.prob_cal, [want[v] for v in got.prob], atol=1e-9)
    assert got.sort_values("prob").prob_cal.is_monotonic_increasing


def test_sigmoid_minimises_the_penalised_loss(spark, data):
    y, p = data
    a, b = calibrate.fit(frame(spark, y, p), "sigmoid")
    z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))

    def loss(a, b):
        m = a * z + b
        return (np.logaddexp(0, m) - y * m).sum() + a * a / 2

    best = loss(a, b)
    assert all(best <= loss(a + da, b + db) + 1e-6 for da in (-0.02, 0, 0.02) for db in (-0.02, 0, 0.02))


def test_lead_times_and_box(spark):
    rows = [(1, "2020-01-01 00:00", 1, 0.9, "2020-01-01 06:00"), (1, "2020-01-01 03:00", 0, 0.95, "2020-01-01 06:00"), (2, "2020-01-01 00:00", 1, 0.1, "2020-01-01 06:00"), (3, "2020-01-01 09:00", 1, 0.9, "2020-01-01 06:00")]
    df = spark.createDataFrame(rows, "stay_id long, t string, label int, prob double, e string").select("stay_id", F.col("t").cast("timestamp").alias("index_time"), "label", "prob", F.col("e").cast("timestamp").alias("first_event_time"))
    leads = leadtime.lead_times(df, 0.5)
    assert {r["stay_id"]: r["lead_hours"] for r in leads.collect()} == {1: 6.0, 2: None, 3: -3.0}
    assert [r["stay_id"] for r in leadtime.keep(leads, "positive").collect()] == [1]
    values = [1.0, 2, 3, 4, 5, 6, 7, 100]
    box = leadtime.box(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first()
    assert box["median"] == 4.5 and box["whisker_high"] == 7.0 and box["n_outliers"] == 1
    hist = {r["bin"]: r["n"] for r in leadtime.histogram(spark.createDataFrame([(float(v),) for v in (0, 1, 2, 4)], "v double"), "v", 4).collect()}
    assert hist == {0: 1, 1: 1, 2: 1, 3: 1}
