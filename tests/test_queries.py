"""Every registered query with a SQL check, compared in full with DuckDB; plan shapes of all of them."""

import glob
import os

import duckdb
import pytest

from tests.conftest import TESTDATA
from tidegauge.plans import registry
from tools.check import canonical

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{TESTDATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result_as_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    got, want = df.toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 120


def test_flagship_has_one_exchange_per_side(spark, sf):
    """The trailing windows themselves need one shuffle by entity after the hourly merge."""
    from tidegauge.operators import features
    from tidegauge.plans import data as d

    grid = spark.createDataFrame([(1, None)], "stay_id long, index_time timestamp")
    f = features.window_stats(grid, d.series(spark, sf), d.VARIABLES, d.WINDOWS)
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan


def test_scan_is_pruned_and_filtered(spark, sf):
    plan = QUERIES["s3_projected_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)" in plan
    assert "l_extendedprice" not in plan


def test_readings_outside_the_stay_do_not_count_as_seen(spark):
    """A variable seen only after the padded stay gives nulls, not a count of zero."""
    from datetime import datetime, timedelta

    from tidegauge.operators import events, extract, features

    t0 = datetime(2024, 1, 1)
    stays = spark.createDataFrame([(1, t0, t0 + timedelta(hours=10))], "stay_id long, icu_in timestamp, icu_out timestamp")
    readings = spark.createDataFrame([(1, t0 + timedelta(hours=2), "a", 1.0), (1, t0 + timedelta(hours=40), "b", 1.0)], "stay_id long, charttime timestamp, variable string, value double")
    padded = events.padded_stay(stays, "icu_in", "icu_out", 6).select("stay_id", "win_start", "win_end")
    inside = extract.within_stay(readings, padded, "stay_id", "charttime")
    grid = spark.createDataFrame([(1, t0 + timedelta(hours=3))], "stay_id long, index_time timestamp")
    row = features.window_stats(grid, inside, ["a", "b"], [6], ["count"]).first()
    assert row["a__6h__count"] == 1.0 and row["b__6h__count"] is None
    plan = features.window_stats(grid, inside, ["a", "b"], [6])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("Join")  # the join with the stay stands below the frames


def test_heads_of_all_sizes_have_one_plan(spark):
    from pyspark.sql import functions as F

    from tidegauge.functions.ordered import head

    df = spark.range(6000).select((F.col("id") % 2).alias("g"), "id", F.shiftright("id", 8).alias("b"))
    plans = set()
    for n in (99, 101, 5000):
        out = head(df, ["g"], [F.col("id")], n, ["b"])
        assert out.count() == 2 * min(n, 3000)
        plans.add(out._jdf.queryExecution().executedPlan().toString().count("Exchange"))
    assert len(plans) == 1


def test_without_a_work_folder_it_fails():
    from tidegauge import session

    class Nothing:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_dir(Nothing)
    session.local_work_dir(Nothing)  # nothing is made up for a cluster


def test_edges_by_arithmetic_are_exact(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tidegauge.functions.scoring import edges_at_or_below

    edges = [i / 100 for i in range(1, 100)]
    values = sorted({*edges, *np.nextafter(edges, 0), *np.nextafter(edges, 1), -5.0, 0.0, 1.0, 7.0})
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", edges_at_or_below("v", edges).alias("k")).collect()
    assert all(r.k == sum(e <= r.v for e in edges) for r in got)
    assert spark.range(1).select(edges_at_or_below(F.lit(None).cast("double"), edges).alias("k")).first().k is None
