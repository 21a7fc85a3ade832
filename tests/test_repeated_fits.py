"""Fits repeated per fold, group and configuration."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 600
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    pdf = pd.DataFrame({
        "stay_id": rng.integers(0, 60, n), "index_time": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n), "h"), "label": y,
        "good": np.where(rng.random(n) < 0.1, np.nan, x[:, 0]), "weak": x[:, 1], "noise": x[:, 2],
    })
    return spark.createDataFrame(pdf).cache()


def test_ablation_takes_other_imputation(rows):
    out = model.ablate(rows, ["good", "weak", "noise"], {"signal": "^good"}, k=2, trees=2, depth=2, impute="approximate").toPandas()
    assert list(zip(out.setting, out.group, out.n_features)) == [("baseline_all", "-", 3), ("drop-one", "signal", 2), ("drop-one", "others", 1), ("keep-only", "signal", 1), ("keep-only", "others", 2)]
    assert out.AUROC_mean[0] > 0.8 > out.AUROC_mean[1]


def test_importance_scores_copies_in_many_tasks(spark, rows, monkeypatch):
    m = model.train(rows, ["good", "weak", "noise"], trees=4, depth=3)
    seen = []
    keep = model.donors
    monkeypatch.setattr(model, "donors", lambda *a: seen.append(a[4]) or keep(*a))
    whole = model.permutation_importance(m, rows, ["good", "weak", "noise"], repeats=2).toPandas()
    monkeypatch.setattr(model, "COPIES_PER_TASK", 300)
    cut = model.permutation_importance(m, rows, ["good", "weak", "noise"], repeats=2).toPandas()
    assert seen == [1, 1, 6, 6]
    assert whole.feature.tolist() == cut.feature.tolist() and np.allclose(whole.importance_mean, cut.importance_mean)
    spread = keep(rows, ["stay_id", "index_time"], ["good"], 1, 6)
    assert spread.rdd.getNumPartitions() == 6 and spread.count() == 600


def test_cut_points_send_no_rows_to_the_driver(spark):
    from tidegauge.functions.ordered import nth_from_hash

    hashed = spark.range(1000).select(F.xxhash64("id").bitwiseAND((1 << 60) - 1).alias("h"))
    cut = nth_from_hash(hashed, "h", {"cut": F.lit(200)})
    assert hashed.where(F.col("h") < cut.first()["cut"]).count() == 200
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_medians_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 999, 30_000):
        pdf = pd.DataFrame({"a": rng.normal(size=n), "b": np.floor(rng.random(n) * 3), "c": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n))})
        df = spark.createDataFrame(pdf).withColumn("d", F.lit(None).cast("double"))
        got = {r["feature"]: r["value"] for r in model.fill_values(df, ["a", "b", "c", "d"]).collect()}
        assert {f: v for f, v in got.items() if v is not None} == pytest.approx(pdf.median().dropna().to_dict(), rel=1e-15)
    monkeypatch.setattr(model, "BRACKET", (0.1, 0.2))  # misses the middle
    got = {r["feature"]: r["value"] for r in model.fill_values(df, ["a", "b", "c"]).collect()}
    assert got == pytest.approx(pdf.median().to_dict(), rel=1e-15)


def test_shared_stages_give_the_same_forests(rows, monkeypatch):
    folded = model.in_folds(rows, "stay_id", 2, 42)
    fitted = []
    keep = model.fit_front
    monkeypatch.setattr(model, "fit_front", lambda *a, **o: fitted.append(a[1]) or keep(*a, **o))
    names, some = ["good", "weak", "noise"], ["noise", "good"]
    options = {"trees": 3, "depth": 3, "impute": "mean", "center": True}
    for cols in (names, some):
        alone = model.cv(folded, cols, 2, **options).first()
        assert not fitted
        shared = model.cv(folded, cols, 2, before=[keep(folded.where(F.col("fold") != f), names, impute="mean", center=True) for f in range(2)], **options).first()
        assert alone == shared
    out = model.grid_search(folded, names, {"n_estimators": [2, 3], "max_depth": [2]}, 2)
    assert out.count() == 2 and len(fitted) == 2
