"""Training, scoring and explaining forest models with Spark ML."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.ordered import hash60, hash_bucket, previous_value, quantiles, running_sums, value_bucket
from tidegauge.operators import split as splits
from tidegauge.operators.dictionary import group_of
from tidegauge.operators.evaluate import merged_scores, rank_merged, rank_metrics
from tidegauge.operators.quality import align_columns
from tidegauge.session import materialize

# The default search grid, scores and sizes.
GRID = {
    "n_estimators": [300, 600],
    "max_depth": [None, 12, 20],
    "max_features": ["sqrt", 0.5],
    "min_samples_leaf": [1, 2],
    "class_weight": ["balanced", "balanced_subsample"],
}
SCORE = "0.7*AP_mean + 0.3*AUROC_mean"
SPARK_MAX_DEPTH = 30
#: Shares of the rows between which the exact median is looked for, ten times as far apart as the approximation errs.
BRACKET = (0.499, 0.501)
#: Copies of rows that one task of the permutation importance scores.
COPIES_PER_TASK = 1_000_000


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Balanced weights n / (2 * n_class), from one aggregation to a single row."""
    n = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("q")
    ).select((F.col("n") / (2 * F.col("p"))).alias("w1"), (F.col("n") / (2 * F.col("q"))).alias("w0"))
    return df.withColumn(out, F.when(F.col(label) == 1, n.select("w1").scalar()).otherwise(n.select("w0").scalar()))


def fill_values(df: DataFrame, features: Sequence[str], how: str = "median") -> DataFrame:
    """(feature, value): the exact median or mean of every feature over its known values."""
    known = df.select([F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features])
    if how == "mean":
        return known.agg(*[F.avg(f).alias(f) for f in features]).unpivot([], list(features), "feature", "value")
    return _medians(known, list(features))


def _medians(known: DataFrame, features: list[str]) -> DataFrame:
    """Exact medians, (feature, value), of the features that have known values.

    Approximate quantiles on both sides of the middle bracket it, for all features in one pass without a shuffle. Values
    below a bracket become -inf and those above it NaN, so that before the shuffle they merge to one row each; the few
    inside are merged by value and ranked. A bracket that misses the middle, which the bound on the approximation
    excludes, leaves its feature to ``quantiles``.
    """
    spark, inf = known.sparkSession, float("inf")
    ends = known.agg(*[F.percentile_approx(f, list(BRACKET), 10_000).alias(f) for f in features]).first().asDict()
    low, high = (F.array(*[F.lit(ends[f][i] if ends[f] else 0.0) for f in features]) for i in (0, 1))
    tall = known.select(F.posexplode(F.array(*features)).alias("at", "v")).where("v is not null")
    lo, hi, v = F.get(low, F.col("at")), F.get(high, F.col("at")), F.col("v")
    cut = F.when(v < lo, F.lit(-inf)).when(v > hi, F.lit(float("nan"))).otherwise(v)
    merged = materialize(tall.groupBy("at", cut.alias("v")).agg(F.count(F.lit(1)).alias("n")), "bracketed")
    below = (v == F.lit(-inf)) & (lo > F.lit(-inf))
    counts = merged.groupBy("at").agg(F.sum(F.when(below, F.col("n")).otherwise(0)).alias("__below"), F.sum("n").alias("__total"))
    inside = merged.where(~below & ~F.isnan("v")).withColumn("__b", value_bucket("v"))
    run = running_sums(inside, ["at"], ["__b"], [v], {"__upto": "n"}).join(F.broadcast(counts), "at")
    rank, upto = (F.col("__total") - 1) * F.lit(0.5), F.col("__below") + F.col("__upto")
    hit = lambda r: (r < upto) & (r >= upto - F.col("n"))
    first, second = F.max(F.when(hit(F.floor(rank)), v)), F.max(F.when(hit(F.ceil(rank)), v))
    found = {features[r["at"]]: r["value"] for r in run.groupBy("at").agg((first + (second - first) * F.max(rank - F.floor(rank))).alias("value")).collect()}
    out = spark.createDataFrame([(f, x) for f, x in found.items() if x is not None], "feature string, value double")
    missed = [f for f in features if ends[f] and found.get(f) is None]
    if missed:
        left = known.select(missed).unpivot([], missed, "feature", "v")
        out = out.unionByName(quantiles(left, "v", [0.5], ["feature"], out="value").select("feature", "value"))
    return out


class _FillParams(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    strategy = Param(Params._dummy(), "strategy", "median or mean, both exact", TypeConverters.toString)


class ExactImputer(Estimator, _FillParams):
    """Learns the exact median or mean of every input column over its known values (see ``fill_values``)."""

    @keyword_only
    def __init__(self, *, strategy: str = "median", inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._setDefault(strategy="median")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExactImputerModel:
        names = list(self.getInputCols())
        found = {r["feature"]: r["value"] for r in fill_values(dataset, names, self.getOrDefault("strategy")).collect()}
        empty = [n for n in names if found.get(n) is None]
        if empty:
            raise ValueError(f"no known values in {empty}")
        return ExactImputerModel(inputCols=names, outputCols=list(self.getOutputCols()), values=[float(found[n]) for n in names])


class ExactImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Puts the learned value where a column is null or NaN. Its state is its parameters, so a saved pipeline holds it."""

    values = Param(Params._dummy(), "values", "one number for each input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, values: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        filled = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("values"))
        return dataset.withColumns({out: F.coalesce(known(c), F.lit(v)) for c, out, v in filled})


def stages(
    features: Sequence[str],
    trees: int = 600,
    depth: int | None = None,
    impute: str = "median",
    scale: bool = True,
    center: bool = False,
    subset: str = "sqrt",
    min_leaf: int = 1,
    seed: int = 42,
    weighted: bool = True,
) -> Pipeline:
    """Impute, assemble, scale, forest. No depth limit becomes Spark's own limit of 30.

    ``impute``: "median" or "mean", both exact, or "approximate" for Spark's own approximate median, one pass over all
    columns, for fits that are repeated many times.
    """
    filled = [f"{f}__filled" for f in features]
    names = {"inputCols": list(features), "outputCols": filled}
    steps = [
        Imputer(strategy="median", **names) if impute == "approximate" else ExactImputer(strategy=impute, **names),
        VectorAssembler(inputCols=filled, outputCol="__raw"),
    ]
    column = "__raw"
    if scale:
        steps.append(StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=center, withStd=True))
        column = "__scaled"
    forest = RandomForestClassifier(
        featuresCol=column, labelCol="label", numTrees=trees, maxDepth=min(depth or SPARK_MAX_DEPTH, SPARK_MAX_DEPTH),
        featureSubsetStrategy=str(subset), minInstancesPerNode=min_leaf, seed=seed,
    )
    if weighted:
        forest = forest.setWeightCol("weight")
    return Pipeline(stages=[*steps, forest])


def _rows(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    return align_columns(df.withColumn("label", F.col(label).cast("double")), features, ["label"])


def fit_front(df: DataFrame, features: Sequence[str], **options) -> PipelineModel:
    """The stages before the forest, for several forests on the same rows."""
    return Pipeline(stages=stages(features, **options).getStages()[:-1]).fit(_rows(df, features))


def train(df: DataFrame, features: Sequence[str], label: str = "label", front: PipelineModel | None = None, **options) -> PipelineModel:
    """Fit on the rows of ``df``; imputation and scaling are learned from them alone.

    ``front``: these stages, fitted on the same rows with the same options for ``features`` or more; each column is
    filled and scaled by itself, so a forest of some of them takes its slots of the vector.
    """
    every = bundle_features(front) if front else list(features)
    rows = _rows(df, every, label)
    weighted = options.get("weighted", True)
    rows = class_weights(rows) if weighted else rows
    pipeline = stages(features, **options)
    if front:
        forest, before = pipeline.getStages()[-1], list(front.stages)
        if every != list(features):
            before.append(VectorSlicer(inputCol=forest.getFeaturesCol(), outputCol="__chosen", indices=[every.index(f) for f in features]))
            forest = forest.setFeaturesCol("__chosen")
        pipeline = Pipeline(stages=[*before, forest])
    fitted = pipeline.fit(rows)
    # A fresh copy of the forest carries no training summary, which would drag the session into every task.
    return PipelineModel([*fitted.stages[:-1], fitted.stages[-1].copy()])


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("stay_id", "index_time", "label")) -> DataFrame:
    """Keys and ``prob`` of class 1 for every row. Missing feature columns count as null."""
    have = [k for k in keys if k in df.columns]
    scored = model.transform(align_columns(df, features, have))
    return scored.select(*have, vector_to_array("probability")[1].alias("prob"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def bundle_features(model: PipelineModel) -> list[str]:
    """Feature order as stored in the model itself."""
    return list(model.stages[0].getInputCols())


def in_folds(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """The rows with ``fold``, written once, since every model reads them."""
    return df if "fold" in df.columns else materialize(splits.folds(df, group, k, seed), "folds")


def fronts(folded: DataFrame, features: Sequence[str], k: int, **options) -> list[PipelineModel]:
    """``fit_front`` without each fold."""
    return [fit_front(folded.where(F.col("fold") != f), features, **options) for f in range(k)]


def cross_scores(
    df: DataFrame, features: Sequence[str], k: int = 5, group: str = "stay_id", seed: int = 42, before: Sequence[PipelineModel] | None = None, **options
) -> DataFrame:
    """Out-of-fold scores: for each fold, a model of the other folds scores it. ``df`` may carry ``fold``.

    ``before``: what ``fronts`` gave, if many models share it.
    """
    df = in_folds(df, group, k, seed)
    keys = [c for c in (group, "index_time", "label", "fold") if c in df.columns]
    parts = []
    for f in range(k):
        model = train(df.where(F.col("fold") != f), features, seed=seed, front=before[f] if before else None, **options)
        parts.append(score(model, df.where(F.col("fold") == f), bundle_features(model), keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_metrics(scored: DataFrame) -> DataFrame:
    """AUROC and AP per fold. The merged scores are written: ranking reads them twice, and the models would score twice."""
    return rank_merged(materialize(merged_scores(scored, by=["fold"]), "merged"), ["fold"]).select("fold", "auroc", "ap", "n")


def summary(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation over folds."""
    return per_fold.groupBy(*by).agg(
        F.avg("auroc").alias("AUROC_mean"), F.stddev_pop("auroc").alias("AUROC_std"),
        F.avg("ap").alias("AP_mean"), F.stddev_pop("ap").alias("AP_std"),
    )


def cv(df: DataFrame, features: Sequence[str], k: int = 5, **options) -> DataFrame:
    return summary(fold_metrics(cross_scores(df, features, k, **options)))


def parse_grid(text: str) -> dict[str, list]:
    """``name=v,v;name=v``: integers, decimals, ``none`` or words."""

    def value(v: str):
        v = v.strip()
        if v.lower() == "none":
            return None
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                continue
        return v

    return {k.strip(): [value(v) for v in vs.split(",")] for k, _, vs in (p.partition("=") for p in text.split(";") if p.strip())}


def _options(cfg: Mapping[str, object]) -> dict:
    names = {"n_estimators": "trees", "max_depth": "depth", "max_features": "subset", "min_samples_leaf": "min_leaf"}
    out = {names[k]: v for k, v in cfg.items() if k in names and v is not None}
    out["weighted"] = cfg.get("class_weight") is not None
    return out


def grid_search(
    df: DataFrame, features: Sequence[str], grid: Mapping[str, Sequence] | None = None, k: int = 5, formula: str = SCORE, group: str = "stay_id", seed: int = 42
) -> DataFrame:
    """One row per configuration with cross-validated metrics and ``score``, best first.

    ``formula`` is a SQL expression over AP_mean and AUROC_mean. Folds are assigned and filled and scaled once; each
    configuration's out-of-fold scores are distributed, and only metrics are gathered.
    """
    grid = dict(grid or GRID)
    spark = df.sparkSession
    folded = in_folds(df, group, k, seed)
    shared = {"impute": "mean", "center": True}
    before = fronts(folded, features, k, **shared)
    rows = []
    for i, values in enumerate(itertools.product(*grid.values())):
        cfg = dict(zip(grid, values))
        m = cv(folded, features, k, group=group, seed=seed, before=before, **shared, **_options(cfg)).first()
        rows.append((i, *[None if v is None else str(v) for v in values], *m))
    names = ", ".join(f"{c} string" for c in grid)
    table = spark.createDataFrame(rows, f"config int, {names}, AUROC_mean double, AUROC_std double, AP_mean double, AP_std double")
    return table.withColumn("score", F.expr(formula)).orderBy(F.col("score").desc(), "config")


def refit_best(df: DataFrame, features: Sequence[str], results: DataFrame, grid: Mapping[str, Sequence], top: int = 1, seed: int = 42) -> list[PipelineModel]:
    """Models of the ``top`` best configurations, fitted on all rows."""
    order = [r["config"] for r in results.limit(top).collect()]
    configs = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    return [train(df, features, impute="mean", center=True, seed=seed, **_options(configs[i])) for i in order]


def feature_groups(spark: SparkSession, features: Sequence[str], groups: Mapping[str, str]) -> DataFrame:
    """(feature, position, feature_group) by first matching pattern."""
    table = spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, position int")
    return table.withColumn("feature_group", group_of(F.col("feature"), groups))


def ablate(
    df: DataFrame, features: Sequence[str], groups: Mapping[str, str], k: int = 5, mode: str = "both", group: str = "stay_id", seed: int = 42, **options
) -> DataFrame:
    """Cross-validated metrics of all features, without each group, and with each group alone. ``options`` win over mean and centring."""
    spark = df.sparkSession
    options = {"impute": "mean", "center": True, **options}
    named = feature_groups(spark, features, groups).collect()
    members: dict[str, list[str]] = {}
    for r in named:
        members.setdefault(r["feature_group"], []).append(r["feature"])
    runs = [("baseline_all", "-", list(features))]
    if mode in ("drop-one", "both"):
        runs += [("drop-one", g, [f for f in features if f not in set(fs)]) for g, fs in members.items()]
    if mode in ("keep-only", "both"):
        runs += [("keep-only", g, fs) for g, fs in members.items()]
    folded = in_folds(df, group, k, seed)
    before = fronts(folded, features, k, **options)
    rows = []
    for setting, g, cols in runs:
        if cols:
            m = cv(folded, cols, k, group=group, seed=seed, before=before, **options).first()
            rows.append((setting, g, *m, len(cols)))
    return spark.createDataFrame(
        rows, "setting string, group string, AUROC_mean double, AUROC_std double, AP_mean double, AP_std double, n_features int"
    )


# Display order of ablation settings.
SETTING_ORDER = ("baseline_all", "drop-one", "keep-only")


def setting_rank(setting: Column) -> Column:
    out = F.when(setting == SETTING_ORDER[0], 0)
    for i, s in enumerate(SETTING_ORDER[1:], 1):
        out = out.when(setting == s, i)
    return out.otherwise(len(SETTING_ORDER))


def display_order(results: DataFrame) -> DataFrame:
    """Ablation rows: baseline, drop-one, keep-only, then by group."""
    return results.orderBy(setting_rank(F.col("setting")), "group")


def impurity_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, importance) from the forest, highest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(bundle_features(model), values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def donors(df: DataFrame, keys: Sequence[str], features: Sequence[str], seed: int, parts: int | None = None) -> DataFrame:
    """Adds ``__d_*``: the features of the previous row in a seeded hash order, cyclically.

    This is a random permutation of every column with one pass: no row keeps its own value unless equal.
    ``parts``: number of partitions, for callers that do much with each row.
    """
    hashed = df.withColumn("__h", hash60(*keys, seed=seed)).withColumn("__b", hash_bucket("__h"))
    hashed = hashed.repartition(parts, "__b") if parts else hashed
    packed = F.struct(*[F.col(f) for f in features])
    withp = hashed.withColumn("__x", packed)
    lagged = previous_value(withp, [], ["__b"], F.struct("__h", *keys), {"__donor": "__x"})
    wrap = withp.agg(F.max_by("__x", F.struct("__h", *keys)).alias("x")).select("x").scalar()
    return lagged.withColumn("__donor", F.coalesce(F.col("__donor"), wrap)).drop("__h", "__b", "__x")


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("stay_id", "index_time"), repeats: int = 5, metric: str = "ap", seed: int = 42
) -> DataFrame:
    """Mean and population std of the metric's drop when one feature is permuted.

    Rows are filled, assembled and scaled once and written; scaling works slot by slot, so swapping after it is the same.
    Per repeat every row gets one donor row and is copied once per feature with that slot of its vector taken from the
    donor's; the forest scores all copies together and the metric is grouped by slot. The number of tasks follows the
    number of copies, not the few bytes they are made from, and the merged scores are written, since ranking reads
    them twice. The plan has the same size for any number of features.
    """
    base_rows = align_columns(df, features, [*keys, "label"])
    front, back = PipelineModel(model.stages[:-1]), model.stages[-1]
    column = back.getFeaturesCol()
    packed = front.transform(base_rows).select(*keys, "label", vector_to_array(column).alias("__vector"))
    packed = materialize(packed, "vectors")
    prob = vector_to_array("probability")[1].alias("prob")
    base = rank_metrics(back.transform(packed.select("label", array_to_vector("__vector").alias(column))).select("label", prob)).select(metric).scalar()
    tasks = math.ceil(packed.count() * len(features) / COPIES_PER_TASK) or 1
    parts = None
    for r in range(repeats):
        part = donors(packed, keys, ["__vector"], seed + r, tasks).select("label", F.lit(r).alias("repeat"), "__vector", F.col("__donor.__vector").alias("__d"))
        part = part.repartition(tasks)  # the join before may have gathered the rows in fewer tasks
        parts = part if parts is None else parts.unionByName(part)
    copies = parts.select("label", "repeat", "__vector", "__d", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("slot"))
    own, slot = F.col("__vector"), F.col("slot")
    swapped = F.concat(F.slice(own, F.lit(1), slot), F.slice("__d", slot + 1, F.lit(1)), F.slice(own, slot + 2, F.lit(len(features))))
    scored = back.transform(copies.select("slot", "repeat", "label", array_to_vector(swapped).alias(column))).select("slot", "repeat", "label", prob)
    by = ["slot", "repeat"]
    per = rank_merged(materialize(merged_scores(scored, by=by), "merged"), by).withColumn("drop", base - F.col(metric))
    named = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("slot") + 1).alias("feature")
    return per.groupBy(named).agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")).orderBy(
        F.col("importance_mean").desc(), "feature"
    )


def attributions(
    model: PipelineModel,
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("stay_id", "index_time"),
    top: int = 200,
    orders: int = 8,
    background: int = 200,
    seed: int = 42,
) -> DataFrame:
    """Sampled Shapley values of the ``top`` highest scored rows: keys, feature, phi.

    For every row and sampled feature order a background row is chosen by hash. Walking along the order,
    features are switched from the background value to the row's own; the change in score at each switch
    is that feature's contribution. All intermediate rows are scored in one transform.
    """
    from pyspark.sql.window import Window

    scored = model.transform(align_columns(df, features, keys)).withColumn("prob", vector_to_array("probability")[1])
    chosen = scored.orderBy(F.col("prob").desc(), *keys).limit(top).select(*keys, F.struct(*features).alias("own"))
    sampled = align_columns(df, features, keys).withColumn("__h", hash60(*keys, seed=seed)).orderBy("__h", *keys).limit(background)
    numbered = sampled.withColumn("slot", F.row_number().over(Window.orderBy("__h", *keys)) - 1).select("slot", F.struct(*features).alias("base"))
    size = numbered.agg(F.count(F.lit(1))).scalar()
    walks = chosen.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    walks = walks.withColumn("slot", F.pmod(hash60(*keys, "walk", seed=seed), size).cast("int")).join(numbered, "slot")
    names = F.array(*[F.lit(f) for f in features])
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("walk").cast("string"))
    order = F.array_sort(F.transform(names, lambda f: F.struct(F.xxhash64(text, f).alias("h"), f.alias("f"))))
    walks = walks.withColumn("order", F.transform(order, lambda s: s["f"]))
    steps = walks.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = steps.select(
        *keys, "walk", "step", "order",
        *[
            F.when(F.array_position("order", f) <= F.col("step"), F.col(f"own.{f}")).otherwise(F.col(f"base.{f}")).alias(f)
            for f in features
        ],
    )
    probs = model.transform(mixed).select(*keys, "walk", "step", "order", vector_to_array("probability")[1].alias("prob"))
    # One walk has as many steps as there are features: a small, fixed window.
    before = F.lag("prob").over(Window.partitionBy(*keys, "walk").orderBy("step"))
    gains = probs.withColumn("gain", F.col("prob") - before).where(F.col("step") > 0)
    return gains.groupBy(*keys, F.element_at("order", F.col("step")).alias("feature")).agg(F.avg("gain").alias("phi"))


def mean_attribution(phis: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, highest first."""
    return phis.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi")).orderBy(F.col("mean_abs_phi").desc(), "feature")
