"""Splits and folds that are decided by hashes, so no row has to move to learn where it belongs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.ordered import hash60, hash_bucket, nth_from_hash, ranked
from tidegauge.functions.spread import spread_join


def by_group(
    df: DataFrame, group: str, parts: Mapping[str, float] | None = None, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Every group wholly in one split. ``parts`` are shares; the last one named takes the rest.

    The groups are put in hash order; the first ceil(n * share) form the first split, and so on. Only the
    cut hashes are computed from the distinct groups (one row), and each row compares its own hash to them.
    """
    parts = dict(parts or {"test": 0.15, "val": 0.15, "train": 0.70})
    groups = df.select(group).distinct().withColumn("__h", hash60(group, seed=seed))
    names = list(parts)
    counts, share = {}, 0.0
    for i, name in enumerate(names[:-1]):
        share += parts[name]
        counts[f"c{i}"] = F.ceil(F.col("__total") * F.lit(round(share, 12)))
    cuts = nth_from_hash(groups, "__h", counts)
    cut = cuts.select(F.struct(*counts).alias("c")).scalar() if counts else None  # one struct: one subquery for all cuts
    tagged = df.withColumns({"__h": hash60(group, seed=seed), **{c: cut[c] for c in counts}})
    choice: Column | None = None
    for i, name in enumerate(names[:-1]):
        cond = F.col("__h") < F.col(f"c{i}")
        choice = F.when(cond, name) if choice is None else choice.when(cond, name)
    return tagged.withColumn(out, choice.otherwise(names[-1]) if choice is not None else F.lit(names[-1])).drop("__h", *counts)


def stratified(df: DataFrame, label: str, keys: Sequence[str], test_share: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """Rows into train and test at the same share in each class. Rows of one entity may be in both."""
    hashed = df.withColumn("__h", hash60(*keys, seed=seed))
    cuts = {}
    for value in (0, 1):
        part = hashed.where(F.col(label) == value)
        cuts[value] = nth_from_hash(part, "__h", {"cut": F.ceil(F.col("__total") * F.lit(test_share))}).select("cut").scalar()
    cut = F.when(F.col(label) == 1, cuts[1]).otherwise(cuts[0])
    return hashed.withColumn(out, F.when(F.col("__h") < cut, "test").otherwise("train")).drop("__h")


def fold_table(df: DataFrame, group: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """(group, size, fold): groups by falling size are dealt to folds to and fro, which evens out the sizes."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("__h", hash60(group, seed=seed))
    sizes = sizes.withColumns({"__size": -F.col("n_rows"), "__hb": hash_bucket("__h")})
    order = [F.col("n_rows").desc(), F.col("__h"), F.col(group)]
    numbered = ranked(sizes, [], ["__size", "__hb"], order, "__r").withColumn("__r", F.col("__r") - 1)
    turn = F.pmod(F.col("__r"), F.lit(k))
    forth = F.pmod(F.floor(F.col("__r") / k), F.lit(2)) == 0
    return numbered.select(group, "n_rows", F.when(forth, turn).otherwise(k - 1 - turn).cast("int").alias(out))


def folds(df: DataFrame, group: str, k: int = 5, seed: int = 42, out: str = "fold", balanced: bool = True) -> DataFrame:
    """Adds a fold number. ``balanced=False`` takes the hash alone: no shuffle, folds even on average."""
    if not balanced:
        return df.withColumn(out, F.pmod(hash60(group, seed=seed), F.lit(k)).cast("int"))
    table = fold_table(df, group, k, seed, out)
    # the table of folds counts the rows of every group anyway
    return spread_join(df, table.select(group, out), [group], counts=table.select(group, F.col("n_rows").alias("n")))


def by_year(
    df: DataFrame,
    ts: str,
    group: str,
    train_years: tuple[int, int],
    test_years: tuple[int, int],
    val_share: float = 0.2,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Year ranges first, then a share of the training groups as validation.

    A group with rows in both ranges goes to the test side as a whole, so no group is in two splits.
    Rows of other groups outside both ranges are dropped.
    """
    year = F.year(ts)
    spans = df.groupBy(group).agg(
        F.max(year.between(*test_years)).alias("__test"), F.max(year.between(*train_years)).alias("__train"), F.count(F.lit(1)).alias("n")
    )
    train = by_group(spans.where(F.col("__train") & ~F.col("__test")), group, {"val": val_share, "train": 1 - val_share}, seed, out)
    side = train.select(group, out).unionByName(spans.where("__test").select(group, F.lit("test").alias(out)))
    inside = F.when(F.col(out) == "test", year.between(*test_years)).otherwise(year.between(*train_years))
    return spread_join(df, side, [group], counts=spans).where(inside)
