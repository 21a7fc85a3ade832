"""Order-dependent aggregates that never put one whole group into one task.

A running sum, rank or quantile over a group is normally a window partitioned by that group, so a group
with a third of all rows becomes one task. Here each group is cut along its own sort order into buckets,
given by monotone bucket columns (``levels``, coarse to fine):

* window functions run inside one bucket of one group, and
* what the earlier buckets add is taken from a small table of bucket totals.

The results are exact for any bucketing that respects the order; the bucketing only decides how the
work is spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_bucket(value: Column | str) -> Column:
    """Monotone bucket of a double: 65536 buckets per doubling of |value| above 1e-6.

    It needs no look at the data. Probabilities can populate about 1.3 million buckets at most, doubles of
    any size a few million: that bounds the table of bucket totals, however many rows there are.
    """
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    return F.floor(F.signum(v) * F.log2(1 + F.abs(v) * float(1 << 20)) * 65536).cast("long")


def hash_bucket(value: Column | str) -> Column:
    """65536 equal ranges of a non-negative 60-bit hash (see ``hash60``)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.shiftright(v, 44).cast("long")


def hash60(*cols: Column | str, seed: int = 0) -> Column:
    """Deterministic 60-bit hash of the text form of the columns, the same in any engine that has md5."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    levels: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, str],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums of ``measures`` ({output: input column}) inside each ``by`` group.

    ``levels`` are existing bucket columns, ascending along ``order``. Rows that tie in ``order`` are
    summed one after the other, so pre-aggregate to distinct sort keys when ties matter. ``totals`` adds
    group totals ({output: measure}), which the bucket table yields at no extra cost.
    """
    keys = list(by)
    totals = dict(totals or {})
    offsets = bucket_offsets(df, keys, levels, measures, totals)
    cells = [*keys, *levels]
    frame = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(offsets, cells)
    out = joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(src).over(frame) + F.col(f"__off_{name}")).alias(name) for name, src in measures.items()],
        *totals,
    )
    return out


def bucket_offsets(
    df: DataFrame, by: Sequence[str], levels: Sequence[str], measures: Mapping[str, str], totals: Mapping[str, str] | None = None
) -> DataFrame:
    """For each bucket, the sum of every measure over all earlier buckets of its group (``__off_*``)."""
    totals = dict(totals or {})
    keys = list(by)
    table = df.groupBy(*keys, *levels).agg(*[F.sum(src).alias(f"__sum_{name}") for name, src in measures.items()])
    for depth in range(len(levels)):
        upper = [*keys, *levels[:depth]]
        here = [*upper, levels[depth]]
        cell = (
            table
            if depth == len(levels) - 1
            else table.groupBy(*here).agg(*[F.sum(f"__sum_{m}").alias(f"__sum_{m}") for m in measures])
        )
        before = Window.partitionBy(*upper) if upper else Window.partitionBy()
        before = before.orderBy(levels[depth]).rowsBetween(Window.unboundedPreceding, -1)
        part = cell.select(
            *here,
            *[F.coalesce(F.sum(f"__sum_{m}").over(before), F.lit(0)).alias(f"__part_{m}") for m in measures],
            *([F.sum(f"__sum_{m}").over(Window.partitionBy(*keys)).alias(t) for t, m in totals.items()] if depth == 0 else []),
        )
        if depth == 0:
            offsets = part.select(*here, *[F.col(f"__part_{m}").alias(f"__off_{m}") for m in measures], *totals)
        else:
            offsets = part.join(offsets, upper).select(
                *here, *[(F.col(f"__off_{m}") + F.col(f"__part_{m}")).alias(f"__off_{m}") for m in measures], *totals
            )
    return offsets


def ranked(df: DataFrame, by: Sequence[str], levels: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Exact 1-based row number inside each ``by`` group, in ``order`` (which must be total)."""
    return running_sums(df.withColumn("__one", F.lit(1).cast("long")), by, levels, order, {name: "__one"}).drop("__one")


def head(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, levels: Sequence[str] = ()
) -> DataFrame:
    """First ``n`` rows per group, by the plan the caller asks for.

    Without ``levels`` each task sends at most ``n`` rows of a group, and they meet in one task: right for a few rows.
    With ``levels`` (bucket columns along ``order``) rows are ranked by buckets and no task holds a whole head.
    """
    if not levels:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
    return ranked(df, by, levels, order, "__rank").where(F.col("__rank") <= n).drop("__rank")


def previous_value(
    df: DataFrame, by: Sequence[str], levels: Sequence[str], order: Column, values: Mapping[str, str]
) -> DataFrame:
    """``lag`` inside each group: {output: input column}, null for the first row of the group.

    Inside a bucket it is a plain ``lag``; the first row of a bucket takes the last row of the nearest
    earlier bucket that has rows, found on the table of buckets.
    """
    keys = list(by)
    cells = [*keys, *levels]
    packed = F.struct(*[F.col(src).alias(name) for name, src in values.items()])
    last = df.groupBy(*cells).agg(F.max_by(packed, order).alias("__last"))
    along = Window.partitionBy(*keys) if keys else Window.partitionBy()
    carried = last.select(*cells, F.lag("__last").over(along.orderBy(*levels)).alias("__carry"))
    inside = Window.partitionBy(*cells).orderBy(order)
    joined = df.join(carried, cells)
    previous = F.when(F.row_number().over(inside) == 1, F.col("__carry")).otherwise(F.lag(packed).over(inside))
    with_prev = joined.withColumn("__prev", previous)
    return with_prev.select(*df.columns, *[F.col(f"__prev.{name}").alias(name) for name in values])


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    prob_col: str = "p",
    out: str = "q",
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per (group, probability).

    Equal values are merged before anything is ordered, then only the buckets that hold a wanted rank are
    sorted. No task or aggregation buffer ever holds all values of a group.
    """
    keys = list(by)
    v = F.col(value).cast("double")
    merged = (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*[F.col(k) for k in keys], v.alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__b", value_bucket("__v"))
    )
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    along = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    buckets = (
        merged.groupBy(*keys, "__b")
        .agg(F.sum("__n").alias("__m"))
        .select(
            *keys,
            "__b",
            "__m",
            F.coalesce(F.sum("__m").over(along), F.lit(0)).alias("__before"),
            F.sum("__m").over(group).alias("__total"),
        )
        .where(
            F.exists(
                wanted,
                lambda p: (F.floor((F.col("__total") - 1) * p) < F.col("__before") + F.col("__m"))
                & (F.ceil((F.col("__total") - 1) * p) >= F.col("__before")),
            )
        )
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = merged.join(buckets, [*keys, "__b"]).withColumn("__upto", F.col("__before") + F.sum("__n").over(inside))
    rank = (F.col("__total") - 1) * F.col(prob_col)
    low, high = F.floor(rank), F.ceil(rank)
    hit = lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__n"))
    picked = (
        rows.select(*keys, "__v", "__n", "__upto", "__total", F.explode(wanted).alias(prob_col))
        .where(hit(low) | hit(high))
        .select(
            *keys,
            prob_col,
            (rank - low).alias("__w"),
            F.when(hit(low), F.col("__v")).alias("__lo"),
            F.when(hit(high), F.col("__v")).alias("__hi"),
        )
        .groupBy(*keys, prob_col)
        .agg(F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.max("__w").alias("__w"))
    )
    return picked.select(
        *keys, prob_col, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__w")).alias(out)
    )


def quantiles_wide(
    df: DataFrame, value: str, named: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group with one column per named quantile ({column: probability})."""
    tall = quantiles(df, value, sorted(set(named.values())), by)
    return tall.groupBy(*by).agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(c) for c, p in named.items()]
    )


def nth_from_hash(df: DataFrame, hash_col: str, counts: Mapping[str, Column], total: Column | None = None) -> DataFrame:
    """Hash cut points: for each name, the smallest hash such that that many rows lie below it.

    ``counts`` gives, per name, the number of rows wanted below the cut as an expression over ``__total``
    (the row count). One output row. A count equal to the row count gives a cut above every hash.
    """
    levels = df.select(F.col(hash_col).alias("__h")).withColumn("__b", hash_bucket("__h"))
    everything = Window.partitionBy()
    along = everything.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        levels.groupBy("__b")
        .agg(F.count(F.lit(1)).alias("__m"))
        .select(
            "__b",
            "__m",
            F.coalesce(F.sum("__m").over(along), F.lit(0)).alias("__before"),
            F.sum("__m").over(everything).alias("__total"),
        )
        .select("__b", "__m", "__before", *[c.cast("long").alias(f"__c_{n}") for n, c in counts.items()])
        .where(
            " or ".join(f"(__c_{n} >= __before and __c_{n} < __before + __m)" for n in counts)
        )
    )
    inside = Window.partitionBy("__b").orderBy("__h")
    # one bucket for each count at most; left to sizes, the rows' side could be the one that is sent to the driver
    rows = levels.join(F.broadcast(buckets), "__b").withColumn("__rank", F.col("__before") + F.row_number().over(inside) - 1)
    return rows.agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("__rank") == F.col(f"__c_{n}"), F.col("__h"))), F.lit((1 << 62))
            ).alias(n)
            for n in counts
        ]
    )
