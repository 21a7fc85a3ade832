"""Joins of raw rows with a table of one row per key, where some keys may hold a large part of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is heavy. At most 1 / SHARE keys can be.
SHARE = 0.01
#: Rows that one task merges, about; the parts a key is cut into before its rows meet.
TASK_ROWS = 500_000
KEY_PARTS = 16


def heavy_keys(counts: DataFrame, on: Sequence[str], share: float = SHARE) -> DataFrame:
    """(keys, ``__parts``): heavy keys and into how many parts of at most ``share`` of all rows each is cut.

    ``counts`` has one row for each key and ``n``. The result has at most 1 / share rows, whatever the data.
    """
    most = counts.agg(F.sum("n")).scalar() * F.lit(share)
    return counts.where(F.col("n") > most).limit(math.ceil(1 / share)).select(*on, F.ceil(F.col("n") / most).cast("int").alias("__parts"))


def spread_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", share: float = SHARE, counts: DataFrame | None = None) -> DataFrame:
    """``rows.join(lookup, on, how)`` for inner, left, left_semi and left_anti, with the rows of heavy keys dealt to parts.

    ``lookup`` has few rows per key; those of heavy keys are copied once for each part, which adds at most 2 / share
    copies in all. A row's part is a hash of its values, so a retried task deals it alike. ``counts`` (keys, ``n``)
    saves the pass that counts rows by key.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of {how!r} joins can't be dealt out")
    keys = list(on)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(*keys, "n")
    heavy = F.broadcast(heavy_keys(counts, keys, share))
    mixed: Column = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    dealt = rows.join(heavy, keys, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(mixed, F.col("__parts"))).cast("int"))
    copied = lookup.join(heavy, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)))
    return dealt.drop("__parts").join(copied.drop("__parts"), [*keys, "__part"], how).drop("__part")


def even_tasks(rows: DataFrame) -> int:
    """So many tasks that each gets about ``TASK_ROWS`` rows; never fewer than run at once."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_ROWS))


def merged_maxima(rows: DataFrame, on: Sequence[str], values: Sequence[str], n: int) -> DataFrame:
    """The maximum of each of ``values`` per key, for tables with nearly as many keys as rows.

    Merging such rows where they are read keeps all keys of a file split in one task's memory. So rows are dealt to ``n``
    tasks before they are merged: first by key and part, so that a busy key is cut, then by key.
    """
    top = [F.max(v).alias(v) for v in values]
    cut = rows.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(KEY_PARTS)))
    parts = cut.repartition(n, *on, "__part").groupBy(*on, "__part").agg(*top)
    return parts.repartition(n, *on).groupBy(*on).agg(*top)
