"""Metrics of scored tables: (group columns, label 0/1, prob)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.ordered import head, previous_value, quantiles, running_sums, value_bucket
from tidegauge.functions.scoring import edges_at_or_below
from tidegauge.functions.spread import spread_join

# Numbers of calibration bins, curve thresholds and alert thresholds.
N_BINS = 20
DCA_THRESHOLDS = tuple(0.01 + i * ((0.99 - 0.01) / 98) for i in range(98)) + (0.99,)
ALERT_THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
FLOOR = 1e-12

#: Groups whose thresholds or edges are looked up in one list; with more, they are joined.
FEW_GROUPS = 64

#: A threshold is kept this far from 0 and 1 where its odds are taken.
ODDS_CLIP = 1e-6


def uniform_edges(n_bins: int = N_BINS) -> list[float]:
    """n + 1 evenly spaced edges of [0, 1]; each is i times the step, the last is 1."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def _pos(label: str) -> Column:
    return (F.col(label) == 1).cast("long")


def _neg(label: str) -> Column:
    return (F.col(label) != 1).cast("long")


def valid(prob: str, label: str | None = None) -> Column:
    """Rows a metric counts: a score that is neither null nor NaN and, where a label is needed, a label."""
    ok = F.col(prob).isNotNull() & ~F.isnan(F.col(prob).cast("double"))
    return ok & F.col(label).isNotNull() if label else ok


def ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


# -- ranking ---------------------------------------------------------------------------------------------


def sweep(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """Cumulative TP and FP at every distinct score, highest first.

    Columns: group columns, ``score``, ``n_pos`` and ``n_neg`` at the score, ``tp`` and ``fp`` at or above it.
    Equal scores are merged before anything is ordered.
    """
    return _sweep(df, label, prob, by).drop("__p", "__n")


def _sweep(df: DataFrame, label: str, prob: str, by: Sequence[str]) -> DataFrame:
    """``sweep`` plus the class totals ``__p`` and ``__n`` of the group."""
    return _swept(merged_scores(df, label, prob, by), by)


def merged_scores(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """(group columns, score, n_pos, n_neg): one row for each distinct score."""
    rows = df.where(valid(prob, label)).groupBy(*by, F.col(prob).cast("double").alias("score"))
    return rows.agg(F.sum(_pos(label)).alias("n_pos"), F.sum(_neg(label)).alias("n_neg"))


def _swept(merged: DataFrame, by: Sequence[str]) -> DataFrame:
    merged = merged.withColumn("__b", -value_bucket("score"))
    return running_sums(merged, by, ["__b"], [F.col("score").desc()], {"tp": "n_pos", "fp": "n_neg"}, {"__p": "tp", "__n": "fp"}).drop("__b")


def rank_metrics(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware AUROC and average precision per group; null where a group has one class only.

    AUROC is the chance that a positive outranks a negative, ties counting half. Average precision sums
    the precision at each distinct score weighted by the recall gained there.
    """
    return rank_merged(merged_scores(df, label, prob, by), by)


def rank_merged(merged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rank_metrics`` of ``merged_scores``. They are read twice, so scores that cost much are written first."""
    s = _swept(merged, by)
    pos, neg = F.col("n_pos"), F.col("n_neg")
    agg = s.groupBy(*by).agg(
        F.sum(pos).alias("n_pos"),
        F.sum(neg).alias("n_neg"),
        F.sum(neg * (F.col("tp") - pos / 2.0)).alias("__wins"),
        F.sum(pos * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("__prec"),
    )
    both = (pos > 0) & (neg > 0)
    return agg.select(
        *by,
        F.when(both, F.col("__wins") / (pos.cast("double") * neg)).alias("auroc"),
        F.when(both, F.col("__prec") / pos).alias("ap"),
        (pos + neg).alias("n"),
        (pos / (pos + neg)).alias("pos_rate"),
    )


def roc(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = (), drop_collinear: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score plus the origin (threshold null).

    ``drop_collinear`` drops inner points at which neither count changes direction: same step as before
    and after.
    """
    s = _sweep(df, label, prob, by)
    if drop_collinear:
        s = _corners(s, by)
    points = s.select(
        *by, F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("__n")).alias("fpr"), ratio(F.col("tp"), F.col("__p")).alias("tpr")
    )
    origin = points.groupBy(*by).agg(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def _corners(s: DataFrame, by: Sequence[str]) -> DataFrame:
    steps = s.withColumn("__b", value_bucket("score"))
    # Going up in score, the previous row is the next lower score: the step that follows on the curve.
    nxt = previous_value(steps, by, ["__b"], F.col("score"), {"__np": "n_pos", "__nn": "n_neg"})
    same = (F.col("__np") == F.col("n_pos")) & (F.col("__nn") == F.col("n_neg"))
    first = (F.col("tp") == F.col("n_pos")) & (F.col("fp") == F.col("n_neg"))
    return nxt.where(first | F.col("__np").isNull() | ~same)


def pr(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """(threshold, recall, precision) per distinct score plus the end point (null, 0, 1)."""
    points = _sweep(df, label, prob, by).select(
        *by,
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("__p")).alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )
    end = points.groupBy(*by).agg(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return points.unionByName(end)


# -- at a threshold --------------------------------------------------------------------------------------


def confusion(df: DataFrame, thr: Column | float, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, TN, FN with ``prob >= thr``, one aggregation."""
    t = thr if isinstance(thr, Column) else F.lit(float(thr))
    hit, pos = F.col(prob) >= t, F.col(label) == 1
    return df.where(valid(prob, label)).groupBy(*by).agg(
        F.count_if(hit & pos).alias("TP"),
        F.count_if(hit & ~pos).alias("FP"),
        F.count_if(~hit & ~pos).alias("TN"),
        F.count_if(~hit & pos).alias("FN"),
    )


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, F1 and alert rate to TP/FP/TN/FN; undefined ratios are 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "alert_rate": ratio(tp + fp, tp + fp + tn + fn),
        }
    )


def threshold_report(counts: DataFrame, thr: Column | float) -> DataFrame:
    """N, prevalence, sensitivity, specificity, PPV, NPV, accuracy, F1, and net benefit per 100 with its treat-all line.

    Denominators are floored; for the odds the threshold is clipped to [1e-6, 1 - 1e-6], so 0 and 1 are allowed.
    """
    t = thr if isinstance(thr, Column) else F.lit(float(thr))
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    n = tp + fp + tn + fn
    safe = lambda d: F.greatest(d.cast("double"), F.lit(FLOOR))
    clipped = F.greatest(F.least(t, F.lit(1 - ODDS_CLIP)), F.lit(ODDS_CLIP))
    odds = clipped / (1 - clipped)
    prev = (tp + fn) / safe(n)
    return counts.withColumns(
        {
            "threshold": t,
            "N": n,
            "prevalence": prev,
            "sensitivity": tp / safe(tp + fn),
            "specificity": tn / safe(tn + fp),
            "ppv": tp / safe(tp + fp),
            "npv": tn / safe(tn + fn),
            "accuracy": (tp + tn) / safe(n),
            "f1": 2 * tp / safe(2 * tp + fp + fn),
            "net_benefit_per100": 100 * (tp / safe(n) - fp / safe(n) * odds),
            "treat_all_per100": 100 * (prev - (1 - prev) * odds),
        }
    )


def _spread(buckets: DataFrame, by: Sequence[str], thresholds: Column) -> DataFrame:
    """Bucket totals (``__k`` = number of thresholds at or below the score) to counts per threshold.

    There are at most as many buckets as thresholds plus one per group, so this is a tiny table.
    """
    each = buckets.select(*by, "__k", "__pos", "__neg", "__rows", F.posexplode(thresholds).alias("__i", "threshold"))
    hit = F.col("__k") > F.col("__i")
    zero = F.lit(0)
    return each.groupBy(*by, "threshold").agg(
        F.sum(F.when(hit, F.col("__pos")).otherwise(zero)).alias("TP"),
        F.sum(F.when(hit, F.col("__neg")).otherwise(zero)).alias("FP"),
        F.sum(F.when(~hit, F.col("__neg")).otherwise(zero)).alias("TN"),
        F.sum(F.when(~hit, F.col("__pos")).otherwise(zero)).alias("FN"),
        F.sum("__rows").alias("__rows"),
    )


def threshold_counts(
    df: DataFrame,
    thresholds: Sequence[float],
    label: str = "label",
    prob: str = "prob",
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """TP, FP, TN, FN at many fixed thresholds from one pass: rows are bucketed, then buckets are summed."""
    ts = sorted(set(float(t) for t in thresholds))
    w = F.col(weight).cast("double") if weight else F.lit(1)
    ok = valid(prob, label) & (F.col(weight).isNotNull() if weight else F.lit(True))
    buckets = (
        df.where(ok)
        .groupBy(*by, edges_at_or_below(prob, ts).alias("__k"))
        .agg(F.sum(_pos(label) * w).alias("__pos"), F.sum(_neg(label) * w).alias("__neg"), F.count(F.lit(1)).alias("__rows"))
    )
    return _spread(buckets, by, F.array(*[F.lit(t) for t in ts]))


def decision_curve(
    df: DataFrame,
    thresholds: Sequence[float] = DCA_THRESHOLDS,
    label: str = "label",
    prob: str = "prob",
    by: Sequence[str] = (),
    weight: str | None = None,
    per_100: bool = True,
) -> DataFrame:
    """Net benefit of the model, of treating all and of treating none, per threshold inside (0, 1)."""
    inside = [t for t in thresholds if 0 < t < 1]
    c = threshold_counts(df, inside, label, prob, by, weight)
    n = F.col("TP") + F.col("FP") + F.col("TN") + F.col("FN")
    prev = (F.col("TP") + F.col("FN")) / n
    odds = F.col("threshold") / (1 - F.col("threshold"))
    scale = F.lit(100.0 if per_100 else 1.0)
    return c.select(
        *by,
        "threshold",
        ((F.col("TP") / n - F.col("FP") / n * odds) * scale).alias("nb_model"),
        ((prev - (1 - prev) * odds) * scale).alias("nb_treat_all"),
        F.lit(0.0).alias("nb_treat_none"),
        (prev * scale).alias("prevalence"),
        (F.round(n).cast("long") if weight else F.col("__rows")).alias("n"),
    )


def alert_table(df: DataFrame, thresholds: Sequence[float] = ALERT_THRESHOLDS, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """Alert rate, precision, recall, F1 and counts per threshold."""
    return prf(threshold_counts(df, thresholds, label, prob, by).drop("__rows"))


# -- thresholds from alert rates -------------------------------------------------------------------------


def threshold_for_rate(df: DataFrame, rate: float, prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """The score that a share ``rate`` of rows reaches: the (1 - rate) quantile; 1 for none, 0 for all."""
    if rate <= 0 or rate >= 1:
        fixed = F.lit(1.0 if rate <= 0 else 0.0).alias("threshold")
        return df.groupBy(*by).agg(fixed)
    return quantiles(df, prob, [1.0 - rate], by, out="threshold").select(*by, "threshold")


def _with_group_value(rows: DataFrame, values: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Adds the column ``name`` of a table with one row per group. Rows whose group is null or not there go.

    Up to ``FEW_GROUPS`` groups enter as one scalar list, so no row moves; with more, rows of heavy groups are dealt to
    parts of a join.
    """
    if not keys:
        return rows.withColumn(name, values.select(name).scalar())
    if rows.select(*keys).distinct().limit(FEW_GROUPS + 1).count() > FEW_GROUPS:
        return spread_join(rows, values, keys)
    listed = values.select(F.struct(*keys, name).alias("v")).agg(F.collect_list("v").alias("all")).scalar()
    own = F.filter("__groups", lambda v: reduce(and_, [v[k] == F.col(k) for k in keys]))
    return rows.withColumn("__groups", listed).withColumn("__own", F.get(own, F.lit(0))).where("__own is not null").withColumn(name, F.col("__own")[name]).drop("__groups", "__own")


def sweep_rates(pooled: DataFrame, rates: Sequence[float], label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """For each target alert rate the quantile threshold and its metrics, ``target_rate`` first.

    The (few) thresholds per group form one sorted array, so the table is bucketed in one pass.
    """
    keys = list(by)
    wanted = {1.0 - r: r for r in rates}
    thr = quantiles(pooled, prob, list(wanted), keys, prob_col="__q", out="threshold")
    arrays = thr.groupBy(*keys).agg(F.array_sort(F.collect_set("threshold")).alias("__ts"))
    tagged = _with_group_value(pooled, arrays, keys, "__ts")
    k = F.size(F.filter("__ts", lambda t: t <= F.col(prob)))
    buckets = (
        tagged.where(valid(prob))
        .groupBy(*keys, k.alias("__k"), "__ts")
        .agg(F.sum(_pos(label)).alias("__pos"), F.sum(_neg(label)).alias("__neg"), F.count(F.lit(1)).alias("__rows"))
    )
    counts = _spread_column(buckets, keys)
    rate = F.coalesce(*[F.when(F.col("__q") == F.lit(q), F.lit(float(r))) for q, r in wanted.items()])
    return prf(thr.withColumn("target_rate", rate).join(counts, [*keys, "threshold"])).select(
        *keys, "target_rate", "threshold", "alert_rate", "precision", "recall", "f1", "TP", "FP", "TN", "FN"
    )


def _spread_column(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    return _spread(buckets, by, F.col("__ts")).drop("__rows")


def profiles(sweep_table: DataFrame, targets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The sweep row nearest to each target alert rate; ties take the higher precision."""
    each = sweep_table.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    gap = F.round(F.abs(F.col("alert_rate") - F.col("target")), 12)
    best = F.min_by(
        F.struct("threshold", "alert_rate", "precision", "recall", "f1"), F.struct(gap, -F.col("precision"), F.col("threshold"))
    )
    return each.groupBy(*by, "target").agg(best.alias("b")).select(*by, "target", "b.*")


def chosen_threshold(params: DataFrame, sources: Sequence[str], manual: float | None = None, demo: float | None = None) -> DataFrame:
    """First stored value by source order, else the manual one, else the demonstration one.

    ``params`` is a (key, value) settings table.
    """
    found = [F.max(F.when(F.col("key") == s, F.col("value").try_cast("double"))) for s in sources]
    tail = [F.lit(v).cast("double") for v in (manual, demo) if v is not None]
    return params.agg(F.coalesce(*found, *tail).alias("threshold"))


# -- calibration -----------------------------------------------------------------------------------------


def brier(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    return df.where(valid(prob, label)).groupBy(*by).agg(F.avg(F.pow(F.col(prob) - F.col(label), 2)).alias("brier"))


def uniform_bin(prob: str = "prob", n_bins: int = N_BINS) -> Column:
    """0-based left-closed bin; 1.0 belongs to the last one. Compared with literal edges."""
    k = edges_at_or_below(prob, uniform_edges(n_bins)) - 1
    return F.least(F.greatest(k, F.lit(0)), F.lit(n_bins - 1))


def reliability(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = (), bin_: Column | None = None) -> DataFrame:
    """Mean prediction, observed rate and size of every non-empty bin (left-closed bins)."""
    b = bin_ if bin_ is not None else uniform_bin(prob)
    return df.where(valid(prob, label)).groupBy(*by, b.alias("bin")).agg(
        F.avg(prob).alias("prob_pred"), F.avg(F.col(label).cast("double")).alias("prob_true"), F.count(F.lit(1)).alias("n")
    )


def ece(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = (), bins: int = N_BINS, strategy: str = "uniform") -> DataFrame:
    """Expected calibration error: bin gaps weighted by bin size.

    ``quantile`` uses the data's own quantiles as edges, and uniform edges where they are not distinct.
    """
    keys = list(by)
    if strategy == "uniform":
        curve = reliability(df, label, prob, keys, uniform_bin(prob, bins))
    elif strategy == "quantile":
        curve = reliability(with_quantile_bins(df, prob, keys, bins), label, prob, keys, F.col("__bin"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    gap = F.col("n") * F.abs(F.col("prob_true") - F.col("prob_pred"))
    return curve.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def with_quantile_bins(df: DataFrame, prob: str, by: Sequence[str], bins: int) -> DataFrame:
    """Adds ``__bin`` by the group's own quantile edges (at most bins + 1 numbers per group)."""
    keys = list(by)
    edges = quantiles(df, prob, [i / bins for i in range(bins + 1)], keys)
    arrays = edges.groupBy(*keys).agg(F.array_sort(F.collect_set("q")).alias("__edges"))
    uniform = F.array(*[F.lit(e) for e in uniform_edges(bins)])
    arrays = arrays.withColumn("__edges", F.when(F.size("__edges") < bins + 1, uniform).otherwise(F.col("__edges")))
    tagged = _with_group_value(df, arrays, keys, "__edges")
    k = F.size(F.filter("__edges", lambda e: e <= F.col(prob))) - 1
    return tagged.withColumn("__bin", F.least(F.greatest(k, F.lit(0)), F.size("__edges") - 2)).drop("__edges")


def calibration_summary(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """n, positive rate, Brier score and ECE from one aggregation per bin."""
    keys = list(by)
    per_bin = df.where(valid(prob, label)).groupBy(*keys, uniform_bin(prob).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("double")).alias("y"),
        F.sum(prob).alias("p"),
        F.sum(F.pow(F.col(prob) - F.col(label), 2)).alias("sq"),
    )
    return per_bin.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum("y") / F.sum("n")).alias("pos_rate"),
        (F.sum("sq") / F.sum("n")).alias("brier"),
        (F.sum(F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"),
    )


def evaluate(df: DataFrame, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """AUROC, AP, Brier, ECE, positive rate and n per group."""
    keys = list(by)
    ranks = rank_metrics(df, label, prob, keys).select(*keys, "auroc", "ap")
    cal = calibration_summary(df, label, prob, keys)
    if keys:
        return cal.join(ranks, keys, "left")
    # one struct, so that both values come from one subquery
    both = ranks.select(F.struct("auroc", "ap").alias("r")).scalar()
    return cal.select("*", both["auroc"].alias("auroc"), both["ap"].alias("ap"))


# -- entity level ----------------------------------------------------------------------------------------


def pool(df: DataFrame, entity: str = "stay_id", label: str = "label", prob: str = "prob", by: Sequence[str] = (), missing: str = "drop") -> DataFrame:
    """Highest score and label per entity. ``missing="zero"`` counts a missing score as 0."""
    if missing not in ("drop", "zero"):
        raise ValueError(f"unknown policy {missing!r}")
    p = F.when(valid(prob), F.col(prob)).otherwise(F.lit(0.0)) if missing == "zero" else F.col(prob)
    src = df if missing == "zero" else df.where(valid(prob))
    return src.groupBy(*by, entity).agg(F.max(label).alias(label), F.max(p).alias(prob))


def entity_alerts(
    df: DataFrame,
    thr: float,
    entity: str = "stay_id",
    ts: str = "index_time",
    label: str | None = "label",
    prob: str = "prob",
    by: Sequence[str] = (),
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Highest score, first time at or above the threshold, 0/1 prediction and label per entity, one pass."""
    hit = F.col(prob) >= F.lit(float(thr))
    aggs = [F.max(prob).alias("max_prob"), F.min(F.when(hit, F.col(ts))).alias("first_alert_time")]
    if label:
        aggs.insert(0, F.max(label).alias("stay_label"))
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    out = df.groupBy(*by, entity).agg(*aggs)
    return out.withColumn("stay_pred", F.coalesce((F.col("max_prob") >= F.lit(float(thr))).cast("int"), F.lit(0)))


def join_scores(base: DataFrame, scores: DataFrame, keys: Sequence[str] = ("stay_id", "index_time"), missing: str = "drop", prob: str = "prob") -> DataFrame:
    """Base rows with their score; rows without one are dropped, set to 0, or kept (``keep``)."""
    joined = base.join(scores.select(*keys, prob), list(keys), "left")
    if missing == "drop":
        return joined.where(valid(prob))
    return joined.fillna(0.0, [prob]) if missing == "zero" else joined


def error_tables(stays: DataFrame) -> DataFrame:
    """Adds ``type`` TP/FP/TN/FN to entity rows with stay_label and stay_pred."""
    y, p = F.col("stay_label") == 1, F.col("stay_pred") == 1
    return stays.withColumn("type", F.when(y & p, "TP").when(~y & p, "FP").when(~y & ~p, "TN").otherwise("FN"))


def error_windows(
    df: DataFrame, stays: DataFrame, k: int = 3, entity: str = "stay_id", ts: str = "index_time", prob: str = "prob", types: Sequence[str] = ("FP", "FN")
) -> DataFrame:
    """Top-k windows by score of every entity of the given error types.

    The top k are taken first, so the join sees at most k rows per entity however long the entity is.
    """
    best = head(df.withColumn("__p", F.coalesce(F.col(prob), F.lit(0.0))), [entity], [F.col("__p").desc(), F.col(ts)], k)
    kinds = error_tables(stays).where(F.col("type").isin(*types)).select(entity, "type")
    return best.drop("__p").join(kinds, entity)
