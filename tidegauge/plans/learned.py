"""Queries that split, train, calibrate and explain.

All features are used, but for m5 and m12 (``FEW``), at five folds and five repeats. What is smaller than the operators' own defaults (forests
of 300 to 600 unlimited trees, 48 grid configurations, exact attributions of all rows) is set in FOREST, CV_FOREST and in
the grid and sampling parameters below, so that the queries end in minutes on eight cores.
"""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import alerts, calibrate, evaluate, features, grid, leadtime, model, quality, split
from tidegauge.plans import data as d
from tidegauge.plans.catalog import query, sql
from tidegauge.plans.scored import TALL, ece_sql, rank_sql
from tidegauge.plans.timeline import wide_sql, window_ctes
from tidegauge.session import materialize, new_path
from tidegauge.sources import writers

FOREST = {"trees": 12, "depth": 5}
# Fits that are repeated per fold or group take Spark's approximate median; all others the exact one.
CV_FOREST = {"trees": 6, "depth": 4, "impute": "approximate"}
FOLDS = 5
REPEATS = 5
FEATURES = [f"{v}__{w}h__{s}" for v in d.VARIABLES for w in d.WINDOWS for s in features.STATS]
FEW = [f"{v}__24h__{s}" for v in ("error", "purchase", "view") for s in ("mean", "count")]


def trainset(spark, sf, horizon: int = 48, names=FEATURES) -> DataFrame:
    """Labelled features of one horizon, written once because training reads it many times."""
    stats = [s for s in features.STATS if any(n.endswith(f"__{s}") for n in names)]
    wide = features.window_stats(d.grid_points(spark, sf), d.extracted(spark, sf), d.VARIABLES, d.WINDOWS, stats)
    labelled = grid.label(wide, "first_event_time", [horizon])
    return materialize(labelled.select("stay_id", "index_time", "label", "first_event_time", *names), "trainset")


def splits(spark, sf, names=FEATURES) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = materialize(split.by_group(trainset(spark, sf, names=names), "stay_id"), "split")
    return tuple(t.where(F.col("split") == s) for s in ("train", "val", "test"))


# -- splits ------------------------------------------------------------------------------------------------


@query(
    "m1_group_split",
    sql([f"g AS (SELECT o_custkey, row_number() OVER (ORDER BY {d.h60('o_custkey', seed=42)}) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders) x)"],
        "SELECT o_orderkey, o.o_custkey, CASE WHEN r < ceil(n * 0.15) THEN 'test' WHEN r < ceil(n * 0.3) THEN 'val' ELSE 'train' END AS split FROM orders o JOIN g ON o.o_custkey = g.o_custkey"),
)
def m1(spark, sf):
    """Customers wholly in one split; each row compares its own hash to two cut points."""
    return split.by_group(d.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query(
    "m2_stratified_split",
    sql([d.SCORED,
         f"r AS (SELECT stay_id, index_time, label, row_number() OVER (PARTITION BY label ORDER BY {d.h60('stay_id', 'epoch_us(index_time)', seed=42)}) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM scored)"],
        "SELECT stay_id, index_time, label, CASE WHEN r < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r", ints=["label"]),
)
def m2(spark, sf):
    """A fifth of the rows of each class."""
    s = d.scored(spark, sf).select("stay_id", "index_time", "label", F.unix_micros("index_time").alias("us"))
    return split.stratified(s, "label", ["stay_id", "us"]).drop("us")


@query(
    "m3_group_folds",
    sql([f"g AS (SELECT o_custkey, count(*) AS n_rows, row_number() OVER (ORDER BY count(*) DESC, {d.h60('o_custkey', seed=42)}) - 1 AS r FROM orders GROUP BY 1)"],
        "SELECT o_custkey, n_rows, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM g", ints=["n_rows", "fold"]),
)
def m3(spark, sf):
    """Groups dealt to five folds by size, to and fro."""
    return split.fold_table(d.table(spark, sf, "orders"), "o_custkey", 5)


_FOLDS = (
    f"g AS (SELECT stay_id, count(*) AS n_rows, row_number() OVER (ORDER BY count(*) DESC, {d.h60('stay_id', seed=42)}) - 1 AS r FROM scored GROUP BY 1)",
    "f AS (SELECT stay_id, n_rows, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM g)",
)


@query("m3_fold_sizes", sql([d.SCORED, *_FOLDS], "SELECT fold, sum(n_rows) AS n_rows, count(*) AS n_groups FROM f GROUP BY 1", ints=["fold", "n_rows", "n_groups"]))
def m3_sizes(spark, sf):
    """Rows and groups per fold."""
    f = split.folds(d.scored(spark, sf), "stay_id", 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("stay_id").alias("n_groups"))


# -- training ----------------------------------------------------------------------------------------------


# The training table and its split in SQL: features of 24 hours, groups in hash order.
_FEW_SQL, _FEW_NAMES = wide_sql([24], ["mean", "count"], ["error", "purchase", "view"])
_TRAINSET = [
    *window_ctes([24]),
    f"feats AS ({_FEW_SQL})",
    f"ranks AS (SELECT stay_id, row_number() OVER (ORDER BY {d.h60('stay_id', seed=42)}) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT stay_id FROM grid) x)",
    "trainset AS (SELECT f.*, CASE WHEN r < ceil(n * 0.15) THEN 'test' WHEN r < ceil(n * 0.3) THEN 'val' ELSE 'train' END AS split FROM feats f JOIN ranks USING (stay_id))",
]


# The same with all features.
_WIDE_SQL, _WIDE_NAMES = wide_sql(d.WINDOWS, features.STATS, d.VARIABLES)
_WIDE = [*window_ctes(d.WINDOWS), f"feats AS ({_WIDE_SQL})", *_TRAINSET[-2:]]
_TRAIN_TALL = "tall AS (UNPIVOT (SELECT {} FROM trainset WHERE split = 'train') ON * INTO NAME feature VALUE v)".format(", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _WIDE_NAMES))


@query("m4_exact_fill_values", sql([*_WIDE, _TRAIN_TALL], "SELECT feature, 'median' AS how, median(v) AS value FROM tall GROUP BY 1 UNION ALL SELECT feature, 'mean', avg(v) FROM tall GROUP BY 1", ["value"]))
def m4_exact(spark, sf):
    """Exact medians and means of the training part."""
    train, _, _ = splits(spark, sf)
    a = model.fill_values(train, FEATURES).withColumn("how", F.lit("median"))
    return a.unionByName(model.fill_values(train, FEATURES, "mean").withColumn("how", F.lit("mean")))


@query(
    "m4_imputer",
    sql([*_WIDE, "med AS (SELECT {} FROM trainset WHERE split = 'train')".format(", ".join(f"median({c}) AS {c}" for c in _WIDE_NAMES))],
        "SELECT split, {}, count(*) AS n FROM trainset t, med GROUP BY 1".format(", ".join(f"avg(coalesce(t.{c}, med.{c})) AS {c}" for c in _WIDE_NAMES)),
        _WIDE_NAMES, ["n"]),
)
def m4(spark, sf):
    """Exact medians of the training part fill all parts, by the imputer of the training pipeline."""
    train, val, test = splits(spark, sf)
    fitted = model.ExactImputer(strategy="median", inputCols=FEATURES, outputCols=[f"{c}_f" for c in FEATURES]).fit(train)
    both = fitted.transform(train.unionByName(val).unionByName(test))
    return both.groupBy("split").agg(*[F.avg(f"{c}_f").alias(c) for c in FEATURES], F.count(F.lit(1)).alias("n"))


_KNOWN = "known AS (SELECT split, error__24h__count AS x FROM trainset WHERE split IN ('train', 'test') AND error__24h__count IS NOT NULL AND view__24h__count IS NOT NULL)"
_SPREAD = "spread AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM known WHERE split = 'train')"


@query(
    "m5_scaler",
    sql([*_TRAINSET, _KNOWN, _SPREAD],
        "SELECT split, FALSE AS centered, avg(x / s) AS mean_0, stddev_samp(x / s) AS std_0 FROM known, spread GROUP BY 1 UNION ALL "
        "SELECT split, TRUE, avg((x - m) / s), stddev_samp((x - m) / s) FROM known, spread GROUP BY 1", ["mean_0", "std_0"]),
)
def m5(spark, sf):
    """Centred and uncentred scaling by the training part's spread."""
    train, _, test = splits(spark, sf, FEW)
    cols = ["error__24h__count", "view__24h__count"]
    va = VectorAssembler(inputCols=cols, outputCol="x", handleInvalid="skip")
    out = None
    for center in (False, True):
        fitted = StandardScaler(inputCol="x", outputCol="z", withMean=center, withStd=True).fit(va.transform(train))
        z = fitted.transform(va.transform(train.unionByName(test))).select("split", vector_to_array("z").alias("z"))
        part = z.groupBy("split").agg(F.avg(F.col("z")[0]).alias("mean_0"), F.stddev_samp(F.col("z")[0]).alias("std_0")).withColumn("centered", F.lit(center))
        out = part if out is None else out.unionByName(part)
    return out


def _fit_score(spark, sf):
    train, val, test = splits(spark, sf)
    cols = quality.select_columns(train, FEATURES)
    m = model.train(train, cols, **FOREST)
    return m, cols, train, val, test


@query("m6_forest")
def m6(spark, sf):
    """A weighted forest on grouped splits: metrics of each split."""
    m, cols, train, val, test = _fit_score(spark, sf)
    scored = model.score(m, train.unionByName(val).unionByName(test), cols, ["split", "label"])
    return evaluate.evaluate(materialize(scored, "scored"), by=["split"])


@query("m6_stratified_baseline")
def m6_baseline(spark, sf):
    """The baseline path: rows split by class, median imputation, no scaling, test metrics and the report line."""
    t = trainset(spark, sf).withColumn("us", F.unix_micros("index_time"))
    s = materialize(split.stratified(t, "label", ["stay_id", "us"]), "split")
    cols = quality.select_columns(t, FEATURES, inclusive=False)
    m = model.train(s.where(F.col("split") == "train"), cols, scale=False, **FOREST)
    scored = model.score(m, s.where(F.col("split") == "test"), cols)
    return evaluate.rank_metrics(scored).withColumn("n_features_used", F.lit(len(cols)))


@query("m7_grouped_cv")
def m7(spark, sf):
    """Out-of-fold AUROC and AP, mean and spread over folds."""
    return model.cv(trainset(spark, sf), FEATURES, FOLDS, **CV_FOREST)


@query("m8_grid_search")
def m8(spark, sf):
    """A small grid ranked by a formula over the cross-validated metrics."""
    grid_ = model.parse_grid("n_estimators=3,6;max_depth=2;max_features=sqrt;class_weight=balanced,none")
    return model.grid_search(trainset(spark, sf), FEATURES, grid_, FOLDS)


@query("m9_ablation")
def m9(spark, sf):
    """All features, without each group, and each group alone."""
    groups = {"errors": "^error", "purchases": "^purchase"}
    return model.display_order(model.ablate(trainset(spark, sf), FEATURES, groups, FOLDS, trees=3, depth=3, impute="approximate"))


@query("m10_impurity_importance")
def m10(spark, sf):
    m, _, *_ = _fit_score(spark, sf)
    return model.impurity_importance(m, spark)


@query("m11_permutation_importance")
def m11(spark, sf):
    """Drop of average precision when a feature is permuted, all features and repeats in one scoring pass."""
    m, cols, _, _, test = _fit_score(spark, sf)
    return model.permutation_importance(m, test, cols, repeats=REPEATS)


@query("m12_attributions")
def m12(spark, sf):
    """Mean absolute sampled Shapley values of the highest scored windows."""
    train, _, test = splits(spark, sf, FEW)
    m = model.train(train, FEW, **FOREST)
    return model.mean_attribution(model.attributions(m, test, FEW, top=50, orders=4, background=50))


@query("m12_top_rows")
def m12_rows(spark, sf):
    """Attributions of the ten highest scored windows, one row each and feature."""
    train, _, test = splits(spark, sf, FEW)
    m = model.train(train, FEW, **FOREST)
    return model.attributions(m, test, FEW, top=10, orders=4, background=50)


@query("m13_batch_scoring")
def m13(spark, sf):
    """A score for every window, with keys and label."""
    m, cols, train, val, test = _fit_score(spark, sf)
    return model.score(m, train.unionByName(val).unionByName(test), cols)


# -- calibration ---------------------------------------------------------------------------------------------


def _raw(spark, sf):
    s = d.scored_splits(spark, sf).where(F.col("method") == "raw")
    return s.where(F.col("split") == "val"), s.where(F.col("split") == "test")


# The isotonic fit by its max-min formula over the distinct scores, then linear interpolation between them.
_ISOTONIC = [
    d.SCORED, *d.SPLITS,
    "v AS (SELECT prob AS x, sum(label) AS y, count(*) AS w FROM splits WHERE method = 'raw' AND split = 'val' GROUP BY 1)",
    "r AS (SELECT x, y, w, row_number() OVER (ORDER BY x) AS i, sum(y) OVER (ORDER BY x) AS sy, sum(w) OVER (ORDER BY x) AS sw FROM v)",
    "block AS (SELECT p.x, j.i, min((k.sy - j.sy + j.y) / CAST(k.sw - j.sw + j.w AS DOUBLE)) AS low FROM r p JOIN r j ON j.i <= p.i JOIN r k ON k.i >= p.i GROUP BY 1, 2)",
    "iso AS (SELECT x, max(low) AS f FROM block GROUP BY 1)",
    "asked AS (SELECT DISTINCT split, prob FROM splits WHERE method = 'raw' AND split IN ('val', 'test'))",
    "around AS (SELECT split, prob, (SELECT max(x) FROM iso WHERE x <= prob) AS lo, (SELECT min(x) FROM iso WHERE x >= prob) AS hi FROM asked)",
    "mapped AS (SELECT split, prob, CASE WHEN lo IS NULL THEN b.f WHEN hi IS NULL OR lo = hi THEN a.f ELSE a.f + (b.f - a.f) * (prob - lo) / (hi - lo) END AS prob_cal FROM around LEFT JOIN iso a ON a.x = lo LEFT JOIN iso b ON b.x = hi)",
]


@query("c1_isotonic", sql(_ISOTONIC, "SELECT split, prob, prob_cal FROM mapped", ["prob", "prob_cal"]))
def c1(spark, sf):
    """Fitted on val, applied to val and test: the map at every distinct score."""
    val, test = _raw(spark, sf)
    fitted = calibrate.fit(val, "isotonic")
    return calibrate.apply(fitted, val.unionByName(test)).select("split", "prob", "prob_cal").distinct()


_CALIBRATED = "calibrated AS (SELECT s.split, s.label, s.prob, m.prob_cal FROM splits s JOIN mapped m ON m.split = s.split AND m.prob = s.prob WHERE s.method = 'raw')"
_REPORT_KEYS = ["split", "stage"]


@query(
    "c1_isotonic_report",
    sql([*_ISOTONIC, _CALIBRATED, TALL],
        "SELECT r.*, b.brier, c.ece FROM (" + rank_sql("tall", by=_REPORT_KEYS) + ") r JOIN (SELECT split, stage, avg(pow(prob - label, 2)) AS brier FROM tall GROUP BY ALL) b USING (split, stage) "
        "JOIN (" + ece_sql("tall", by=_REPORT_KEYS) + ") c USING (split, stage)",
        ["auroc", "ap", "pos_rate", "brier", "ece"], ["n"]),
)
def c1_report(spark, sf):
    val, test = _raw(spark, sf)
    return calibrate.before_after(calibrate.apply(calibrate.fit(val, "isotonic"), val.unionByName(test)), ["split"])


@query("c2_sigmoid")
def c2(spark, sf):
    val, test = _raw(spark, sf)
    fitted = calibrate.fit(val, "sigmoid")
    return calibrate.apply(fitted, val.unionByName(test)).select("split", "prob", "prob_cal").distinct()


@query("c5_cv_calibrated")
def c5(spark, sf):
    """The mean of five models, each calibrated on the fold it did not see."""
    train, _, test = splits(spark, sf)
    scored = calibrate.cv_calibrated(train, test, FEATURES, "isotonic", FOLDS, **CV_FOREST)
    return calibrate.before_after(materialize(scored, "scored"))


# -- models and releases -----------------------------------------------------------------------------------------


@query("s12_model_persistence", sql(_TRAINSET, f"SELECT count(*) AS n, 0.0 AS max_diff, {len(FEATURES)} AS n_features FROM trainset WHERE split = 'test'", ["max_diff"], ["n", "n_features"]))
def s12(spark, sf):
    """A saved and reloaded model gives the same scores: windows, largest difference, features kept."""
    train, _, test = splits(spark, sf)
    m = model.train(train, FEATURES, **FOREST)
    path = new_path(spark, "model")
    model.save(m, path)
    again = model.load(path)
    a = model.score(m, test, FEATURES)
    b = model.score(again, test, model.bundle_features(again)).withColumnRenamed("prob", "prob_again")
    both = a.join(b.drop("label"), ["stay_id", "index_time"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("prob") - F.col("prob_again"))).alias("max_diff")).withColumn(
        "n_features", F.lit(len(model.bundle_features(again)))
    )


@query("s13_release_record")
def s13(spark, sf):
    """Model, threshold at a tenth of validation entities, test metrics and lead times as one settings table."""
    train, val, test = splits(spark, sf)
    m = model.train(train, FEATURES, **FOREST)
    path = new_path(spark, "release")
    model.save(m, f"{path}/model")
    pooled = evaluate.pool(model.score(m, val, FEATURES))
    thr = evaluate.threshold_for_rate(pooled, 0.1).first()["threshold"]
    scored = materialize(model.score(m, test, FEATURES, ["stay_id", "index_time", "label", "first_event_time"]), "scored")
    metrics = evaluate.evaluate(scored)
    lead = leadtime.stats(leadtime.lead_times(scored, thr))
    out = writers.release_table(spark, "h48", f"{path}/model", 48, thr, FEATURES, metrics=metrics, lead=lead)
    return out.where(F.col("key") != "model_path")


@query("l1_release_to_alerts")
def l1_release(spark, sf):
    """Saved model to alerts: score a table, one row per entity, daily cap and refractory suppression."""
    train, _, test = splits(spark, sf)
    path = new_path(spark, "model")
    model.save(model.train(train, FEATURES, **FOREST), path)
    m = model.load(path)
    scored = materialize(model.score(m, test, model.bundle_features(m)), "scored")
    kept = alerts.suppress(scored, 0.5, alerts.REFRACTORY_HOURS).groupBy("stay_id").agg(F.count(F.lit(1)).alias("n_alerts"))
    return alerts.batch(scored, 0.5, daily_cap=50).join(kept, "stay_id", "left")
