"""Bucketed running sums, ranks, lags and quantiles against plain pandas, with one hot group."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.functions import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, scores with ties, outliers and negatives."""
    rng = np.random.default_rng(3)
    n = 6000
    g = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 200, n))
    v = np.round(rng.normal(0, 1, n), 2)
    v[::997] = 1e12
    v[1::997] = -1e9
    pdf = pd.DataFrame({"g": g, "v": v, "k": np.arange(n)})
    return pdf, spark.createDataFrame(pdf).cache()


def test_running_sums(skewed):
    pdf, df = skewed
    out = ordered.running_sums(
        df.withColumn("b", ordered.value_bucket("v")).withColumn("one", F.lit(1)), ["g"], ["b"], [F.col("v"), F.col("k")],
        {"upto": "one"}, {"total": "upto"},
    ).toPandas()
    want = pdf.sort_values(["g", "v", "k"]).assign(upto=lambda x: x.groupby("g").cumcount() + 1)
    got = out.sort_values(["g", "v", "k"])
    assert (got.upto.to_numpy() == want.upto.to_numpy()).all()
    assert (got.total.to_numpy() == want.groupby("g").v.transform("size").to_numpy()).all()


def test_two_levels_rank(skewed):
    pdf, df = skewed
    leveled = df.withColumns({"s": F.floor("v").cast("long"), "b": ordered.value_bucket(F.col("v") - F.floor("v"))})
    got = ordered.ranked(leveled, [], ["s", "b"], [F.col("v"), F.col("k")], "r").toPandas().sort_values("r")
    assert (got.r.to_numpy() == np.arange(1, len(pdf) + 1)).all()
    assert (got.k.to_numpy() == pdf.sort_values(["v", "k"]).k.to_numpy()).all()


@pytest.mark.parametrize("n", [3, 1500])
def test_head(skewed, n):
    pdf, df = skewed
    got = ordered.head(df.withColumn("b", ordered.value_bucket("v")), ["g"], [F.col("v"), F.col("k")], n, ["b"]).toPandas()
    want = pdf.sort_values(["v", "k"]).groupby("g").head(n)
    assert set(got.k) == set(want.k)


def test_previous_value(skewed):
    pdf, df = skewed
    got = ordered.previous_value(df.withColumn("b", F.floor(F.col("k") / 100)), ["g"], ["b"], F.col("k"), {"prev": "v"}).toPandas()
    want = pdf.assign(prev=pdf.groupby("g").v.shift())
    pd.testing.assert_series_equal(got.sort_values("k").prev.reset_index(drop=True), want.prev, check_names=False)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(skewed, by):
    pdf, df = skewed
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = ordered.quantiles(df, "v", probs, by).toPandas()
    for key, part in pdf.groupby("g") if by else [(None, pdf)]:
        mine = got[got.g == key] if by else got
        assert np.allclose(mine.sort_values("p").q, np.quantile(part.v, probs), rtol=1e-12)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e15, 1e15), min_size=2, max_size=40))
def test_value_bucket_is_monotone(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("b", ordered.value_bucket("v"))
    got = rows.toPandas().sort_values("v")
    assert got.b.is_monotonic_increasing


def test_hash_cut_is_exact(spark):
    df = spark.range(1000).withColumn("h", ordered.hash60("id", seed=5))
    cut = ordered.nth_from_hash(df, "h", {"a": F.lit(150), "b": F.col("__total")}).first()
    assert df.where(F.col("h") < cut["a"]).count() == 150
    assert df.where(F.col("h") < cut["b"]).count() == 1000
