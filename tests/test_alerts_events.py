"""Alerts, refractory suppression, bursts, interval joins and first events, with a hot entity."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import alerts, cohort, dictionary, events, extract
from tidegauge.streaming import feeds

BASE = datetime(2020, 1, 1)


def at(hours):
    return BASE + timedelta(hours=float(hours))


def scored(spark, rows):
    return spark.createDataFrame([(s, at(h), float(p)) for s, h, p in rows], "stay_id long, index_time timestamp, prob double")


def fold(times, wait):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= wait:
            kept.append(t)
    return kept


def test_refractory_window(spark):
    got = alerts.suppress(scored(spark, [(1, 0, 1), (1, 1, 1), (1, 23, 1), (1, 25, 1)]), 0.5, 24).collect()
    assert sorted(r["alert_time"] for r in got) == [at(0), at(25)]


def test_refractory_on_a_hot_entity_and_odd_gaps(spark):
    rng = np.random.default_rng(5)
    ids = np.where(rng.random(4000) < 0.4, 0, rng.integers(1, 50, 4000))
    minutes = np.where(ids == 0, rng.integers(0, 60_000, 4000), rng.integers(0, 300_000, 4000))
    df = spark.createDataFrame([(int(i), BASE + timedelta(minutes=int(m)), 1.0) for i, m in zip(ids, minutes)], "stay_id long, index_time timestamp, prob double")
    got = {(r["stay_id"], r["alert_time"]) for r in alerts.suppress(df.repartition(5), 0.5, 7.5).collect()}
    want = {(int(i), BASE + timedelta(minutes=int(m))) for i in set(ids) for m in fold(minutes[ids == i], 450)}
    assert got == want


def passed(spark, rows, kept):
    """What a stream can have judged: alerts up to an hour before the newest row."""
    end = max(at(h) for _, h, _ in rows) - timedelta(hours=1)
    return {tuple(r) for r in kept.collect() if r["alert_time"] <= end}


def test_streamed_alerts_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(s), int(h), float(p)) for s, h, p in zip(rng.integers(0, 5, 400), np.sort(rng.integers(0, 500, 400)), rng.random(400))]
    for i in range(0, 400, 100):
        scored(spark, rows[i : i + 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.read_stream(spark, str(tmp_path / "in"), "stay_id long, index_time timestamp, prob double", files_per_trigger=1)
    got = feeds.drain(feeds.alert_feed(stream, 0.5, 24), "t")
    want = alerts.suppress(scored(spark, rows), 0.5, 24)
    assert {tuple(r) for r in got.collect()} == passed(spark, rows, want)


def test_a_hit_that_comes_later_but_is_earlier_wins(spark, tmp_path):
    """Batch 1 has a hit at 10:00; batch 2 brings one at 09:30 and one at 09:45 of the next day; silence is 24 hours."""
    minutes = [[(1, 600)], [(1, 570), (1, 24 * 60 + 585)], [(2, 4000)]]
    src = str(tmp_path / "in")
    for part in minutes:
        df = spark.createDataFrame([(s, BASE + timedelta(minutes=m), 1.0) for s, m in part], "stay_id long, index_time timestamp, prob double")
        df.coalesce(1).write.mode("append").parquet(src)
    stream = feeds.read_stream(spark, src, "stay_id long, index_time timestamp, prob double", files_per_trigger=1)
    got = {tuple(r) for r in feeds.drain(feeds.alert_feed(stream, 0.5, 24), "t").collect()}
    assert got == {(1, BASE + timedelta(minutes=570)), (1, BASE + timedelta(minutes=24 * 60 + 585))}


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, rows in enumerate(([(1, 100, 1.0)], [(1, 130, 1.0)], [(2, 10, 1.0)], [(3, 500, 1.0)])):
        scored(spark, rows).coalesce(1).write.mode("append").parquet(src)
        if i == 0:
            stream = feeds.read_stream(spark, src, "stay_id long, index_time timestamp, prob double", files_per_trigger=1)
            feed = feeds.alert_feed(stream, 0.5, 24)
        query = feeds.write(feed, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
        query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, at(100)), (1, at(130))}


def test_daily_cap_keeps_the_earliest(spark):
    df = scored(spark, [(1, 5, 0.9), (2, 3, 0.9), (3, 4, 0.9), (4, 30, 0.9), (5, 2, 0.1)])
    assert {r["stay_id"] for r in alerts.batch(df, 0.5, daily_cap=2).collect()} == {2, 3, 4}
    assert alerts.batch(df, 0.5).count() == 5
    big = alerts.daily_capped(alerts.batch(df, 0.5), 1_500_000)
    assert alerts.batch(df, 0.5, daily_cap=2_000_000).count() == 4  # a large cap is a cap
    assert {r["stay_id"] for r in big.collect()} == {1, 2, 3, 4}


def test_bursts_cross_cell_borders(spark):
    hours = [1, 23.9, 24.05, 24.2, 47.95, 48.0, 48.1, 80]
    df = spark.createDataFrame([("k", at(h)) for h in hours for _ in range(2)], "k string, ts timestamp")
    got = sorted((r["burst_start"], r["burst_end"], r["n_triggers"]) for r in events.debounce(df, ["k"], "ts", 10).collect())
    assert got == [(at(1), at(1), 2), (at(23.9), at(24.2), 6), (at(47.95), at(48.1), 6), (at(80), at(80), 2)]


def test_rate_changes(spark):
    rows = [(0, 0.0), (1, 0.1), (2, 0.14), (50, 0.17), (51, 0.0), (52, 0.3)]
    df = spark.createDataFrame([("k", at(h), r) for h, r in rows], "k string, ts timestamp, rate double")
    got = {(r["ts"], r["change"]) for r in events.rate_changes(df, ["k"], "ts", "rate", 0.5, F.lit(0.02)).collect()}
    assert got == {(at(1), "start"), (at(2), "upgrade"), (at(50), "upgrade"), (at(52), "start")}


def test_interval_join_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    reads = [(int(k), at(h)) for k, h in zip(np.where(rng.random(800) < 0.4, 0, rng.integers(1, 20, 800)), rng.uniform(0, 300, 800))]
    stays = [(int(k), int(i), at(s), at(s + n)) for i, (k, s, n) in enumerate(zip(rng.integers(0, 20, 40), rng.uniform(0, 250, 40), rng.uniform(0, 90, 40)))]
    r = spark.createDataFrame(reads, "k long, ts timestamp")
    s = spark.createDataFrame(stays, "k long, sid long, win_start timestamp, win_end timestamp")
    got = sorted((x["k"], x["ts"], x["sid"]) for x in extract.within_stay(r, s, "k", "ts").collect())
    want = sorted((k, t, i) for k, t in reads for q, i, a, b in stays if q == k and a <= t <= b)
    assert got == want


def test_interval_ends_are_closed(spark):
    r = spark.createDataFrame([(1, at(10)), (1, at(34)), (1, at(9.999)), (1, at(34.001))], "k long, ts timestamp")
    s = spark.createDataFrame([(1, at(10), at(34))], "k long, win_start timestamp, win_end timestamp")
    assert {x["ts"] for x in extract.within_stay(r, s, "k", "ts").collect()} == {at(10), at(34)}


def test_detect_first_events(spark):
    ids = spark.createDataFrame([("vasopressors", 1), ("imv", 2), ("crrt", 3)], "category string, itemid long")
    inputs = spark.createDataFrame([(1, 1, at(5), 0.0, 0.0), (1, 1, at(7), None, 2.0), (2, 1, at(1), 1.0, None), (1, 2, at(0), 1.0, 1.0)], "stay_id long, itemid long, starttime timestamp, rate double, amount double")
    procs = spark.createDataFrame([(1, 2, at(6)), (1, 3, at(9)), (1, 1, at(0)), (9, 2, at(1))], "stay_id long, itemid long, starttime timestamp")
    base = spark.createDataFrame([(1,), (2,), (3,)], "stay_id long")
    got = {r["stay_id"]: r for r in events.detect(base, inputs, procs, ids).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["vaso_time"], got[1]["imv_time"], got[1]["crrt_time"], got[1]["first_event_time"]) == (at(7), at(6), at(9), at(6))
    assert got[2]["first_event_time"] == at(1) and got[3]["first_event_time"] is None


def test_series_from_raw_tables(spark):
    co = spark.createDataFrame([(10, 100, 1, at(0), at(24))], "subject_id long, hadm_id long, stay_id long, icu_in timestamp, icu_out timestamp")
    var = spark.createDataFrame([(5, "hr")], "itemid long, variable string")
    chart = spark.createDataFrame(
        [(1, None, at(-6), None, 5, 80.0, "x"), (1, 100, at(30.1), None, 5, 81.0, None), (1, 100, at(1), None, 6, 1.0, None), (1, 100, at(2), None, 5, None, "82")],
        "stay_id long, hadm_id long, charttime timestamp, storetime timestamp, itemid long, valuenum double, value string",
    )
    assert [tuple(r) for r in extract.vitals(chart, co, var).collect()] == [(1, 100, at(-6), "hr", 80.0)]
    lab = spark.createDataFrame(
        [(10, 100, at(1), None, 5, None, " 7.5 "), (10, 100, at(2), None, 5, None, "pending"), (10, 100, at(3), None, 5, 8.0, None), (10, None, at(3), None, 5, 8.0, None)],
        "subject_id long, hadm_id long, charttime timestamp, storetime timestamp, itemid long, valuenum double, value string",
    )
    assert sorted(tuple(r) for r in extract.labs(lab, co, var).collect()) == [(1, 100, at(1), "hr", 7.5), (1, 100, at(3), "hr", 8.0)]


def test_dictionary_overlap_and_words(spark):
    items = spark.createDataFrame([(1, "Phosphate"), (2, "pH "), (3, "PTT"), (4, None)], "itemid long, label string")
    bank = {"ph": ["pH"], "pt": ["PT"], "aptt": ["PTT"]}
    assert {(r["itemid"], r["name"]) for r in dictionary.match_labels(items, bank).collect()} == {(1, "ph"), (2, "ph"), (3, "pt"), (3, "aptt")}
    assert {(r["itemid"], r["name"]) for r in dictionary.match_labels(items, bank, mode="word").collect()} == {(2, "ph"), (3, "aptt")}
    wins = {r["itemid"]: r["variable"] for r in dictionary.last_wins(dictionary.match_labels(items, bank)).collect()}
    assert wins[3] == "aptt"


def test_shipped_event_banks(spark):
    from tidegauge.functions.vocab import EVENT_BANKS

    items = spark.createDataFrame([(1, "Norepinephrine", None, "Medications"), (2, "AC node", "x", None), (3, "CRRT mode", None, None), (4, "PEEP set", None, None)], "itemid long, label string, abbreviation string, category string")
    manual = spark.createDataFrame([("crrt", "crrt", 77)], "category string, name string, itemid long")
    got = {(r["category"], r["itemid"]) for r in dictionary.event_dictionary(items, EVENT_BANKS, ["label", "abbreviation", "category"], manual).collect()}
    assert got == {("vasopressors", 1), ("crrt", 3), ("imv", 4), ("crrt", 77)}


def test_short_first_stay_drops_the_subject(spark):
    p = spark.createDataFrame([(1, 40, "F"), (2, 40, "M"), (3, 10, "M")], "subject_id long, anchor_age int, gender string")
    a = spark.createDataFrame([(s, s * 10, at(0), at(99)) for s in (1, 2, 3)], "subject_id long, hadm_id long, admittime timestamp, dischtime timestamp")
    st = spark.createDataFrame(
        [(1, 10, 1, "A", "A", at(0), at(5), None), (1, 10, 2, "A", "A", at(10), at(90), None), (2, 20, 3, "A", "A", at(0), at(30), None), (3, 30, 4, "A", "A", at(0), at(30), None)],
        "subject_id long, hadm_id long, stay_id long, first_careunit string, last_careunit string, intime timestamp, outtime timestamp, los double",
    )
    d = spark.createDataFrame([(s, s * 10, "C8200", "10") for s in (1, 2, 3)] + [(2, 20, "20010", "9")], "subject_id long, hadm_id long, icd_code string, icd_version string")
    got = cohort.build(p, a, st, d)
    assert [(r["stay_id"], r["los_hours"]) for r in got.collect()] == [(3, 30.0)]
    with pytest.raises(RuntimeError):
        cohort.require_rows(got.where("false"), "cohort")
