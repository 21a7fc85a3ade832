"""The schedule of a mix does not go through the driver."""

import pytest
from pyspark.sql import functions as F

from tidegauge import session
from tidegauge.llm import mixing


@pytest.fixture(scope="module", autouse=True)
def work_dir(spark):
    session.local_work_dir(spark)


def test_cells_of_the_schedule_are_not_broadcast(spark, monkeypatch):
    plans, keep = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    named = spark.createDataFrame([(0, 40_000.0), (1, 9_000.4), (2, 0.0), (3, 1.0)], "source_no int, target double")
    slots = mixing.schedule(named, 100)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
    words = {r["source_no"]: (r["words"], r["n"]) for r in slots.groupBy("source_no").agg(F.sum("words").alias("words"), F.count("*").alias("n")).collect()}
    assert words == {0: (40_000, 400), 1: (9_000, 90), 3: (1, 1)}
    assert [r["slot"] for r in slots.orderBy("slot").collect()] == list(range(491))
