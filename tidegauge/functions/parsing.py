"""Tolerant conversions: what cannot be read becomes null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the first number inside a free text.
NUMBER_IN_TEXT = r"(-?\d+\.?\d*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_long(c: Column | str) -> Column:
    return _col(c).try_cast("bigint")


def to_double(c: Column | str) -> Column:
    """Numeric or null; NaN counts as null because the data model has no NaN."""
    d = _col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def to_time(c: Column | str, fmt: str | None = None) -> Column:
    c = _col(c)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else c.try_cast("timestamp")


def number_in_text(c: Column | str) -> Column:
    """First number found in a text, or null."""
    return F.regexp_extract(_col(c), NUMBER_IN_TEXT, 1).try_cast("double")


def coalesced_value(number: Column | str, text: Column | str) -> Column:
    """Row by row: the numeric column, else the text read as a whole number literal."""
    return F.coalesce(to_double(number), to_double(F.trim(_col(text))))


def first_existing(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """The first candidate that names a column of ``df``, ignoring case."""
    by_lower = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    if required:
        raise KeyError(f"none of {list(candidates)} in {df.columns}")
    return None


# Candidate column names, in order of preference.
TIME_COLUMNS = ("charttime", "chart_time", "chart_time_utc", "storetime", "store_time")
VALUE_COLUMNS = ("valuenum", "value", "valuetext", "value_num")
LABEL_COLUMNS = ("label", "y", "target", "outcome", "event", "label_window", "label_stay")
SPLIT_COLUMNS = ("split", "set", "fold_tag")
AGE_COLUMNS = ("age", "anchor_age", "age_years", "age_at_admission")
SEX_COLUMNS = ("sex", "gender")
UNIT_COLUMNS = ("icu_type", "first_careunit", "careunit", "icutype")


def resolved_value(df: DataFrame, candidates: Sequence[str] = VALUE_COLUMNS) -> Column:
    """Column-level choice: the first candidate column decides; text columns give their first number."""
    name = first_existing(df, candidates)
    if isinstance(df.schema[name].dataType, T.StringType):
        return number_in_text(name)
    return to_double(name)


def normalized(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids, charttime, itemid, value) with the time and value columns resolved and bad rows dropped."""
    time = first_existing(df, TIME_COLUMNS)
    out = df.select(
        *[to_long(i).alias(i) if i in df.columns else F.lit(None).cast("bigint").alias(i) for i in ids],
        to_time(time).alias("charttime"),
        to_long("itemid").alias("itemid"),
        resolved_value(df).alias("value"),
    )
    return out.na.drop(subset=["charttime", "itemid", "value"])
