"""Readers and writers, splits, and the learned path on small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import model, quality, split
from tidegauge.sources import tables, writers


@pytest.fixture()
def root(spark, tmp_path):
    (tmp_path / "hosp" / "deep").mkdir(parents=True)
    (tmp_path / "icu").mkdir()
    (tmp_path / "hosp" / "patients.csv").write_text("subject_id,anchor_age,gender\n1,40,F\n2,x,M\n3,50,M\n")
    (tmp_path / "hosp" / "deep" / "d_labitems.csv").write_text("itemid,label\n7,pH\n")
    return str(tmp_path)


def test_read_by_name(spark, root):
    assert sorted(r["subject_id"] for r in tables.read_table(spark, root, "patients", "hosp").collect()) == [1, 3]
    assert tables.read_table(spark, root, "patients", "hosp", bad_rows="null").count() == 3
    assert tables.read_table(spark, root, "d_labitems", "hosp", columns=["label"]).first()["label"] == "pH"
    assert [r[0] for r in tables.list_tables(spark, root, "hosp").collect()] == ["d_labitems", "patients"]
    got = tables.read_table(spark, root, "patients", "hosp", where=tables.equals_all({"gender": "M"}), columns=["subject_id"], limit=1, order=["subject_id"])
    assert [r[0] for r in got.collect()] == [3]
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, root, "admissions", "hosp")
    with pytest.raises(ValueError):
        tables.list_tables(spark, root, "ward")


def test_parquet_copy_policies(spark, tmp_path):
    df = spark.range(10)
    path = str(tmp_path / "t")
    writers.to_parquet(df, path, where=F.col("id") < 4)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        writers.to_parquet(df, path)
    writers.to_parquet(df, path, if_exists="skip")
    assert spark.read.parquet(path).count() == 4
    writers.to_parquet(df, path, if_exists="overwrite")
    assert spark.read.parquet(path).count() == 10
    with pytest.raises(RuntimeError):
        writers.to_parquet(df, str(tmp_path / "none"), where=F.col("id") < 0)


def test_usable_columns(spark):
    n = 100
    pdf = pd.DataFrame({"ok": np.arange(n, dtype=float), "const": 1.0, "edge": [1.0, 2.0, 3.0, 4.0, 5.0] + [None] * 95, "none": [None] * n, "label": 1})
    df = spark.createDataFrame(pdf, "ok double, const double, edge double, none double, label long").select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("ok", "const", "edge", "none")], "label"
    )
    assert quality.select_columns(df) == ["ok"]
    assert quality.select_columns(df, inclusive=False) == ["ok", "edge"]


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(2)
    n = 1500
    stay = np.where(rng.random(n) < 0.33, 0, rng.integers(1, 80, n))
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    pdf = pd.DataFrame({"stay_id": stay, "index_time": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n), "h"), "label": y, "good": x[:, 0], "noise": x[:, 1]})
    return spark.createDataFrame(pdf).cache()


def test_group_splits_are_disjoint_and_sized(toy):
    out = split.by_group(toy, "stay_id")
    per = out.groupBy("stay_id").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s"))
    assert per.where("n > 1").count() == 0
    counts = {r["s"]: r["count"] for r in per.groupBy("s").count().collect()}
    n = sum(counts.values())
    assert counts["test"] == int(np.ceil(0.15 * n)) and counts["val"] == int(np.ceil(0.3 * n)) - counts["test"]
    assert out.count() == 1500


def test_folds_keep_groups_whole(toy):
    out = split.folds(toy, "stay_id", 4)
    assert out.count() == 1500
    assert out.groupBy("stay_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert out.select("fold").distinct().count() == 4


def test_stratified_share(toy):
    out = split.stratified(toy, "label", ["stay_id", "index_time"]).groupBy("label", "split").count().toPandas().pivot(index="label", columns="split", values="count")
    assert (out.test == np.ceil(0.2 * (out.test + out.train))).all()


def test_forest_finds_the_signal_and_explains_it(spark, toy):
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    names = ["good", "noise"]
    m = model.train(toy, names, trees=8, depth=4)
    assert model.impurity_importance(m, spark).first()["feature"] == "good"
    perm = {r["feature"]: r["importance_mean"] for r in model.permutation_importance(m, toy, names, repeats=2).collect()}
    assert perm["good"] > 0.2 > abs(perm["noise"]) * 2
    phis = model.attributions(m, toy, names, top=10, orders=4, background=20)
    assert model.mean_attribution(phis).first()["feature"] == "good"
    assert phis.count() == 20


def test_donors_are_a_permutation(toy):
    out = model.donors(toy, ["stay_id", "index_time"], ["good", "noise"], 1).select("good", F.col("__donor.good").alias("d")).toPandas()
    assert np.allclose(np.sort(out.good), np.sort(out.d)) and (out.good != out.d).mean() > 0.99


def test_grid_text():
    g = model.parse_grid("n_estimators=3,6;max_depth=None,12;max_features=sqrt,0.5")
    assert g == {"n_estimators": [3, 6], "max_depth": [None, 12], "max_features": ["sqrt", 0.5]}
