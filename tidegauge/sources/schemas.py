"""Declared input schemas. Nothing is inferred: inference costs a pass and drifts between files."""

from __future__ import annotations

# The columns the analytics read, per (area, table).
RAW = {
    ("hosp", "patients"): "subject_id long, anchor_age int, gender string",
    ("hosp", "admissions"): "subject_id long, hadm_id long, admittime timestamp, dischtime timestamp",
    ("icu", "icustays"): (
        "subject_id long, hadm_id long, stay_id long, first_careunit string, last_careunit string, "
        "intime timestamp, outtime timestamp, los double"
    ),
    ("hosp", "diagnoses_icd"): "subject_id long, hadm_id long, icd_code string, icd_version string",
    ("hosp", "d_icd_diagnoses"): "icd_code string, long_title string",
    ("icu", "d_items"): "itemid long, label string, abbreviation string, category string, linksto string",
    ("hosp", "d_labitems"): "itemid long, label string",
    ("icu", "inputevents"): "stay_id long, itemid long, starttime timestamp, rate double, amount double",
    ("icu", "procedureevents"): "stay_id long, itemid long, starttime timestamp",
    ("icu", "chartevents"): (
        "stay_id long, hadm_id long, charttime timestamp, storetime timestamp, itemid long, "
        "valuenum double, value string"
    ),
    ("hosp", "labevents"): (
        "subject_id long, hadm_id long, charttime timestamp, storetime timestamp, itemid long, "
        "valuenum double, value string"
    ),
}

COHORT = (
    "subject_id long, hadm_id long, stay_id long, icu_in timestamp, icu_out timestamp, los_hours double, "
    "age int, gender string, first_careunit string, last_careunit string, admittime timestamp, dischtime timestamp"
)
SERIES = "stay_id long, hadm_id long, charttime timestamp, variable string, value double"
LABELS = "stay_id long, index_time timestamp, horizon_hours int, label int, first_event_time timestamp"
PREDICTIONS = "stay_id long, index_time timestamp, label int, prob double"
