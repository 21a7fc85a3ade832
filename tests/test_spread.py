"""Heavy keys, pointer doubling, pooled blocks, exact imputation and slot swaps against plain versions."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidegauge.functions import spread
from tidegauge.functions.spread import heavy_keys, spread_join
from tidegauge.operators import alerts, calibrate, events, model, split
from tidegauge.plans import data

BASE = datetime(2020, 1, 1)


def times(spark, rows):
    """(entity, minute) rows as scored hits."""
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["stay_id", "m"]))
    return df.select("stay_id", F.timestamp_micros(F.lit(int((BASE - datetime(1970, 1, 1)).total_seconds()) * 1_000_000) + F.col("m") * 60_000_000).alias("index_time"), F.lit(1.0).alias("prob"))


def fold(minutes, wait):
    kept = []
    for t in sorted(set(minutes)):
        if not kept or t - kept[-1] >= wait:
            kept.append(t)
    return kept


def as_minutes(df):
    return sorted((r["stay_id"], round((r["alert_time"] - BASE) / timedelta(minutes=1))) for r in df.collect())


@pytest.mark.parametrize("short", [0, 3, 50])
@pytest.mark.parametrize("hours", [0.5, 7.5, 24])
def test_pointers_reach_what_the_fold_keeps(spark, short, hours):
    rng = np.random.default_rng(int(short + hours))
    ids = np.where(rng.random(3000) < 0.5, 0, rng.integers(1, 30, 3000))
    minutes = rng.integers(0, np.where(ids == 0, 20_000, 60_000))
    want = sorted((int(i), int(m)) for i in set(ids) for m in fold(minutes[ids == i].tolist(), hours * 60))
    assert as_minutes(alerts.suppress(times(spark, {"stay_id": ids, "m": minutes}).repartition(5), 0.5, hours, short=short)) == want


def test_one_dense_entity_is_chased_on_many_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("stay_id"), F.timestamp_micros(F.col("id") * 7 * 60_000_000).alias("index_time"), F.lit(1.0).alias("prob"))
    got = alerts.suppress(df, 0.5, 24.0)
    step = -(-24 * 60 // 7)  # the first hit at least a day later
    assert got.count() == -(-n // step)
    jump = alerts.successors(df.select("stay_id", F.unix_micros("index_time").alias("__t")), "stay_id", 24 * 3_600_000_000)
    per_task = [r["n"] for r in jump.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) > 1 and max(per_task) < n / 2


def test_heavy_keys_are_dealt_out(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500 + 100).cast("long").alias("k"), F.col("id").alias("v"), F.lit("x").alias("a.b"))
    lookup = spark.createDataFrame([(7, "hot"), (101, "a"), (103, "b"), (999, "none")], "k long, name string")
    heavy = heavy_keys(rows.groupBy("k").agg(F.count("*").alias("n")), ["k"]).collect()
    assert [(r["k"], r["__parts"]) for r in heavy] == [(7, 50)]
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = spread_join(rows, lookup, ["k"], how), rows.join(lookup, ["k"], how)
        assert a.columns == b.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError):
        spread_join(rows, lookup, ["k"], "full")


def test_no_task_gets_a_heavy_key(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ids = F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 4000 + 100).cast("long")
        rows = spark.range(100_000).select(ids.alias("k"), F.col("id").alias("v"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"))
        keys = rows.select("k").distinct().withColumn("start", F.lit(BASE).cast("timestamp"))
        joins = [spread_join(rows, keys, ["k"]), events.members(rows, keys, "k"), events.since(rows, keys, "k", "ts", "start"), split.folds(rows, "k", 5)]
        for df in joins:
            n = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            assert sum(n) == 100_000 and max(n) <= 2 * np.median(n)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def pooled(x, y):
    """Pool adjacent violators over distinct scores, one after the other."""
    out = []
    for v in np.unique(x):
        out.append([v, v, y[x == v].sum(), (x == v).sum()])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1][1:] = [last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return out


def test_blocks_do_not_depend_on_the_cut(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random(3000), 3)
    y = (rng.random(3000) < x**2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"prob": x, "label": y})).repartition(7)
    want = [tuple(map(float, b)) for b in pooled(x, y)]
    for n in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert [tuple(r) for r in calibrate.blocks(df).orderBy("lo").collect()] == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    asked = spark.createDataFrame([(0.0,), (1.0,), (0.1234567,), (None,), (float("nan"),), (0.999,)], "prob double")
    got = {str(r["prob"]): r["prob_cal"] for r in calibrate.apply(calibrate.fit(df, "isotonic"), asked).collect()}
    knots = sorted({(b[0], b[2] / b[3]) for b in want} | {(b[1], b[2] / b[3]) for b in want})
    for p in (0.0, 1.0, 0.1234567, 0.999):
        assert got[str(p)] == pytest.approx(np.interp(p, [k[0] for k in knots], [k[1] for k in knots]))
    assert got["None"] is None and got["nan"] is None


def test_imputer_is_exact_and_survives_saving(spark, tmp_path):
    rows = [(float(i) if i % 7 else None, float("nan") if i % 5 == 0 else float(i * i)) for i in range(1, 1000)]
    df = spark.createDataFrame(rows, "a double, b double")
    a, b = [r[0] for r in rows if r[0] is not None], [r[1] for r in rows if r[1] == r[1]]
    fitted = Pipeline(stages=[model.ExactImputer(strategy="median", inputCols=["a", "b"], outputCols=["x", "y"])]).fit(df)
    assert fitted.stages[0].getOrDefault("values") == [np.median(a), np.median(b)]
    fitted.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert sorted(map(str, again.transform(df).collect())) == sorted(map(str, fitted.transform(df).collect()))
    assert again.transform(df).where("x is null or y is null or isnan(y)").count() == 0
    mean = model.ExactImputer(strategy="mean", inputCols=["a"], outputCols=["x"]).fit(df)
    assert mean.getOrDefault("values") == pytest.approx([np.mean(a)])
    with pytest.raises(ValueError):
        model.ExactImputer(inputCols=["a"], outputCols=["x"]).fit(df.where("a is null"))


def test_importance_plan_does_not_grow_with_the_square_of_features(spark):
    sizes = []
    for k in (10, 80):
        names = [f"f{i}" for i in range(k)]
        df = spark.range(400).select(F.col("id").alias("stay_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("index_time"), (F.col("id") % 2).cast("double").alias("label"), *[(F.col("id") * (i + 3) % 17 + (F.col("id") % 2) * (9 if i == 0 else 0)).cast("double").alias(n) for i, n in enumerate(names)])
        m = model.train(df, names, trees=3, depth=2, impute="mean", subset="all")
        out = model.permutation_importance(m, df, names, repeats=2)
        assert out.first()["feature"] == "f0" and out.count() == k
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 3 * sizes[0]


def test_maxima_are_merged_in_even_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"a": np.where(rng.random(6000) < 0.3, 0, rng.integers(0, 4000, 6000)), "b": rng.integers(0, 2, 6000), "v": rng.random(6000)})
    df = spark.createDataFrame(rows).select(F.when(F.col("a") != 7, F.col("a")).alias("a"), "b", F.when(F.col("v") > 0.1, F.col("v")).alias("v"))
    monkeypatch.setattr(spread, "TASK_ROWS", 200)
    n = spread.even_tasks(df)
    assert n == 30
    got = spread.merged_maxima(df, ["a", "b"], ["v"], n)
    want = df.groupBy("a", "b").agg(F.max("v").alias("v"))
    key = lambda r: str((r.a, r.b))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert got.rdd.getNumPartitions() == n


def test_scored_rows_are_dealt_before_they_are_merged(spark, sf):
    plan = data.scored(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.rindex("HashAggregate") :]
