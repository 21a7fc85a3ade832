"""Grids, labels and alignment on hand-made stays."""

from datetime import datetime, timedelta

import pytest

from tidegauge.operators import grid


def t(text):
    return datetime.fromisoformat(text)


def stays(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "stay_id long, icu_in timestamp, icu_out timestamp, ev timestamp")


def points(df):
    return [r["index_time"] for r in df.orderBy("index_time").collect()]


EXAMPLE = (t("2020-01-01 08:23"), t("2020-01-03 05:40"), t("2020-01-02 01:15"))


def test_worked_example(spark):
    got = points(grid.hourly(stays(spark, EXAMPLE), event="ev"))
    assert got == [t("2020-01-01 15:00") + timedelta(hours=i) for i in range(11)]


def test_modes_differ_at_the_end_on_the_event_and_for_early_events(spark):
    plain = (t("2020-01-01 00:00"), t("2020-01-01 10:00"), None)
    assert points(grid.hourly(stays(spark, plain), event="ev"))[-1] == t("2020-01-01 09:00")
    assert points(grid.hourly(stays(spark, plain), event="ev", mode="cap"))[-1] == t("2020-01-01 10:00")
    on_point = (*plain[:2], t("2020-01-01 08:00"))
    assert points(grid.hourly(stays(spark, on_point), event="ev"))[-1] == t("2020-01-01 07:00")
    assert points(grid.hourly(stays(spark, on_point), event="ev", mode="cap"))[-1] == t("2020-01-01 08:00")
    early = (*plain[:2], t("2020-01-01 02:00"))
    assert points(grid.hourly(stays(spark, early), event="ev")) == []
    assert len(points(grid.hourly(stays(spark, early), event="ev", mode="cap"))) == 5


@pytest.mark.parametrize("mode", ["prune", "cap"])
def test_short_and_empty_stays_have_no_points(spark, mode):
    short = (t("2020-01-01 00:00"), t("2020-01-01 05:30"), None)
    empty = (t("2020-01-01 00:00"), t("2020-01-01 00:00"), None)
    assert points(grid.hourly(stays(spark, short, empty), event="ev", mode=mode)) == []


def test_strict_raises_on_reversed_stays(spark):
    bad = (t("2020-01-02 00:00"), t("2020-01-01 00:00"), None)
    with pytest.raises(Exception, match="stay ends before"):
        grid.hourly(stays(spark, bad), strict=True).collect()


def test_label_edges(spark):
    rows = [(t("2020-01-02 00:00"), t("2020-01-01 00:00")), (t("2020-01-01 00:00"), t("2020-01-01 00:00")), (None, t("2020-01-01 00:00")), (t("2020-01-02 00:01"), t("2020-01-01 00:00"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "stay_id long, ev timestamp, index_time timestamp")
    got = {r["stay_id"]: r["label"] for r in grid.label(df, "ev", [24]).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0}
    with pytest.raises(ValueError):
        grid.label(df, "ev", [0])


def test_nearest_within_tolerance(spark):
    marks = [("a", t("2020-01-01 01:00")), ("a", t("2020-01-01 02:00")), ("a", t("2020-01-01 02:10"))]
    asks = ["00:55", "00:54:59", "01:05", "01:05:01", "01:30", "02:05", "02:04:59", "02:00", "02:15:01"]
    want = ["01:00", None, "01:00", None, None, "02:10", "02:00", "02:00", None]
    g = spark.createDataFrame(marks, "e string, g timestamp")
    p = spark.createDataFrame([(i, "a", t(f"2020-01-01 {a}")) for i, a in enumerate(asks)], "i int, e string, ts timestamp")
    got = {r["i"]: r["aligned"] for r in grid.align_nearest(p, g, "e", "ts", "g", 5).collect()}
    assert [got[i] for i in range(len(asks))] == [t(f"2020-01-01 {w}") if w else None for w in want]


def test_leak_check(spark):
    rows = [(t("2020-01-01 01:00"), t("2020-01-01 01:00")), (t("2020-01-01 01:10"), t("2020-01-01 01:00"))]
    r = grid.leak_check(spark.createDataFrame(rows, "f timestamp, c timestamp"), "f", "c").first()
    assert (r["ok"], r["n_violations"]) == (False, 1)
