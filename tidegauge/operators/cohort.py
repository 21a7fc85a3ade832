"""Selecting entities: coded admissions of adults, first stay per subject, minimum length of stay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.parsing import to_long
from tidegauge.functions.timefn import hours_between
from tidegauge.functions.vocab import CODE_PREFIXES


def code_match(code: Column | str, version: Column | str, prefixes: Mapping[int, Sequence[str]]) -> Column:
    """True where the code starts with a prefix of its own version."""
    c = F.col(code) if isinstance(code, str) else code
    v = to_long(version)
    per_version = [
        (v == F.lit(ver)) & reduce(or_, [c.startswith(p) for p in starts])
        for ver, starts in prefixes.items()
        if starts
    ]
    return F.coalesce(reduce(or_, per_version, F.lit(False)), F.lit(False))


def length_of_stay(los_days: Column | str, start: Column | str, end: Column | str) -> Column:
    """Hours: the recorded days, else end minus start."""
    los = F.col(los_days) if isinstance(los_days, str) else los_days
    return F.coalesce(los * 24.0, hours_between(end, start))


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group by ``order``, which should end in a unique tiebreak.

    Spark prunes ``row_number() = 1`` before the shuffle, so a task sends one row of a group and a huge group costs no
    more than a small one.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def build(
    patients: DataFrame,
    admissions: DataFrame,
    stays: DataFrame,
    diagnoses: DataFrame,
    min_age: int = 18,
    min_hours: float = 24.0,
    prefixes: Mapping[int, Sequence[str]] = CODE_PREFIXES,
) -> DataFrame:
    """One row per subject: the first stay among coded admissions of adults, if it is long enough.

    The length filter comes after the first stay is chosen, so a short first stay drops the subject.
    Coded admissions and adults select first; the stays that remain are cut down to one per admission, which joins its
    admission one to one.
    """
    adults = patients.where(F.col("anchor_age") >= min_age).select("subject_id", "anchor_age", "gender")
    coded = diagnoses.where(code_match("icd_code", "icd_version", prefixes)).select("subject_id", "hadm_id").distinct()
    wanted = coded.join(adults.select("subject_id"), "subject_id", "left_semi")
    opening = first_per_group(stays.join(wanted, ["subject_id", "hadm_id"], "left_semi"), ["subject_id", "hadm_id"], ["intime", "stay_id"])
    chosen = (
        opening.join(admissions.select("subject_id", "hadm_id", "admittime", "dischtime"), ["subject_id", "hadm_id"])
        .join(adults, "subject_id")
    )
    first = first_per_group(chosen, ["subject_id"], ["intime", "stay_id"])
    return cohort_columns(
        first.withColumn("los_hours", length_of_stay("los", "intime", "outtime")).where(F.col("los_hours") >= min_hours)
    )


def cohort_columns(df: DataFrame) -> DataFrame:
    """Rename and order the cohort columns."""
    return df.withColumnsRenamed({"intime": "icu_in", "outtime": "icu_out", "anchor_age": "age"}).select(
        "subject_id", "hadm_id", "stay_id", "icu_in", "icu_out", "los_hours", "age", "gender",
        "first_careunit", "last_careunit", "admittime", "dischtime",
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise if a stage has no rows."""
    if df.isEmpty():
        raise RuntimeError(f"{what}: no rows left")
    return df
