"""Null, count and edge rules of trailing windows."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tidegauge.operators import features

BASE = datetime(2020, 1, 1)


def at(hours):
    return BASE + timedelta(hours=hours)


def run(spark, grid, readings, variables, **kw):
    g = spark.createDataFrame([(s, at(h)) for s, h in grid], "stay_id long, index_time timestamp")
    r = spark.createDataFrame([(s, at(h), v, float(x)) for s, h, v, x in readings], "stay_id long, charttime timestamp, variable string, value double")
    out = features.window_stats(g, r, variables, **kw)
    return {(r["stay_id"], r["index_time"]): r for r in out.collect()}


def test_mean_of_hourly_means_and_hour_counts(spark):
    got = run(spark, [(1, 10)], [(1, 9.1, "a", 1), (1, 9.8, "a", 3), (1, 10, "a", 10)], ["a"], windows=[6])[(1, at(10))]
    assert got["a__6h__mean"] == 6.0 and got["a__6h__count"] == 2.0 and got["a__6h__last"] == 10.0
    assert got["a__6h__std"] == 4.0 and got["a__6h__trend_last_mean"] == 4.0
    assert (got["a__6h__min"], got["a__6h__max"]) == (2.0, 10.0)


def test_frame_holds_exactly_w_hours(spark):
    got = run(spark, [(1, 10)], [(1, 4.9, "a", 1), (1, 5, "a", 2), (1, 11, "a", 9)], ["a"], windows=[6])[(1, at(10))]
    assert got["a__6h__count"] == 1.0 and got["a__6h__last"] == 2.0


def test_null_rules(spark):
    readings = [(1, 1, "a", 5), (1, 20, "b", 7), (2, 20, "b", 1)]
    got = run(spark, [(1, 20), (1, 40), (2, 20), (3, 20)], readings, ["a", "b", "c"], windows=[6])
    seen_elsewhere = got[(1, at(20))]
    assert seen_elsewhere["a__6h__count"] == 0.0 and seen_elsewhere["a__6h__mean"] is None
    assert seen_elsewhere["c__6h__count"] is None
    empty_frame = got[(1, at(40))]
    assert empty_frame["a__6h__count"] is None and empty_frame["b__6h__count"] is None
    assert got[(2, at(20))]["a__6h__count"] is None and got[(2, at(20))]["b__6h__count"] == 1.0
    assert got[(3, at(20))]["b__6h__count"] is None


def test_minutes_of_the_index_hour(spark):
    readings = [(1, 10 + 59 / 60, "a", 5)]
    assert run(spark, [(1, 10)], readings, ["a"], windows=[6])[(1, at(10))]["a__6h__count"] == 1.0
    assert run(spark, [(1, 10)], readings, ["a"], windows=[6], bucket="ceil")[(1, at(10))]["a__6h__count"] is None


def test_a_hot_stay_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    n = 3000
    readings = [(int(s), float(h), v, float(x)) for s, h, v, x in zip(np.where(rng.random(n) < 0.4, 1, rng.integers(2, 30, n)), rng.uniform(0, 400, n), rng.choice(["a", "b"], n), rng.normal(size=n))]
    grid = [(s, h) for s in range(1, 31) for h in range(6, 400, 7)]
    got = run(spark, grid, readings, ["a", "b"], windows=[6, 24])
    pdf = pd.DataFrame(readings, columns=["s", "h", "v", "x"])
    pdf["h"] = np.floor(pdf["h"])
    hourly = pdf.groupby(["s", "v", "h"]).x.mean().reset_index()
    for s, h in grid:
        row = got[(s, at(h))]
        for w in (6, 24):
            near = hourly[(hourly.s == s) & (hourly.h > h - w) & (hourly.h <= h)]
            for v in ("a", "b"):
                part = near[near.v == v].sort_values("h").x
                name = f"{v}__{w}h__"
                if part.empty:
                    assert row[name + "mean"] is None
                    continue
                want = [part.iloc[-1], part.mean(), part.min(), part.max(), part.std(ddof=0), len(part), part.iloc[-1] - part.mean()]
                assert np.allclose([row[name + k] for k in features.STATS], want, atol=1e-9)


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, 1)], [(1, 1, "a", 1)], ["a"], windows=[0])
    with pytest.raises(ValueError):
        run(spark, [(1, 1)], [(1, 1, "a", 1)], ["a"], bucket="round")
