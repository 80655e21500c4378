"""Outcome classifiers on Spark ML: presets, training, prediction, cross-validation, comparison,
importance and what-if scoring."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.fixed import CATEGORIES, FOLDS, FORM_FEATURES, MEASURES, SEED
from cohortlens.functions.expressions import fixed_text, percent_text, round_even
from cohortlens.operators.metrics import accuracy, auc
from cohortlens.operators.sampling import stratified_folds
from cohortlens.operators.scale import settle, settled_running_totals
from cohortlens.operators.select import best_row, top_k

# Fixed settings of the two model sets. "linear" has regularisation 1/n (penalty C = 1).
BATCH_MODELS = {
    "Logistic Regression": {"kind": "linear", "maxIter": 1000},
    "Random Forest": {"kind": "forest", "numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 5},
    "Gradient Boosting": {"kind": "boost", "maxIter": 200, "maxDepth": 5, "stepSize": 0.05},
    "Boosted Trees, fine bins": {"kind": "boost", "maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "maxBins": 256},
}
INTERACTIVE_MODELS = {
    "Logistic Regression": {"kind": "linear", "maxIter": 1000},
    "Random Forest": {"kind": "forest", "numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 5},
    "Gradient Boosting": {"kind": "boost", "maxIter": 150, "maxDepth": 4, "stepSize": 0.08},
    "Hist Gradient Boost": {
        "kind": "boost", "maxIter": 150, "maxDepth": 5, "stepSize": 0.08,
        "maxBins": 255, "minInstancesPerNode": 20,
    },
}
# Fits that run side by side.
PARALLEL_FITS = 4
# Cells (rows x features x trees grown at once) that a task of a fit takes in a pass.
TASK_CELLS = 4_000_000
# Bins of a feature in trees whose settings name none.
MAX_BINS = 32
# Cells beyond which a pass of boosting is worth another task, as long as cores are idle.
BOOST_CELLS = 1_000_000
# Click deviation assumed for a what-if learner, as a share of the early clicks.
DEVIATION_SHARE = 0.3


def feature_names(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    """The model features that the table has: codes first, then measures."""
    named = [f"{c}_enc" for c in CATEGORIES] + MEASURES
    return [c for c in named if c in df.columns and c not in exclude]


def form_features(df: DataFrame) -> list[str]:
    return [c for c in FORM_FEATURES if c in df.columns]


def model_input(df: DataFrame, features: list[str], target: str = "target", keep: list[str] = ()) -> DataFrame:
    """Features as doubles and the label, 0 where NULL."""
    return df.select(
        *keep,
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
        F.coalesce(F.col(target), F.lit(0)).cast("double").alias("label"),
    )


def bin_edges(rows: DataFrame, features: list[str], bins: list[int]) -> dict[int, list[list[float]]]:
    """By number of bins: for each feature the values at which its bins begin, found from all rows. A feature with no
    more values than bins has one for each value, any other equal shares of the rows. Only the edges reach the driver."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    counted = rows.select(F.explode(cells).alias("_cell")).select("_cell.*").where("value IS NOT NULL AND NOT isnan(value)")
    counted = counted.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("times"), F.lit(1).alias("one"))
    placed = settled_running_totals(*settle(counted), ["feature"], "value", ["times", "one"])
    first = F.col("times_upto") - F.col("times")
    made = {}
    for k in bins:
        share = F.when(F.col("one_all") <= k, F.col("one_upto")).otherwise(F.floor(first * k / F.col("times_all")))
        lows = placed.groupBy("feature", share.alias("share")).agg(F.min("value").alias("low")).collect()
        made[k] = [sorted(r["low"] for r in lows if r["feature"] == i) for i in range(len(features))]
    return made


def make_pipeline(
    features: list[str],
    settings: dict,
    n_rows: int,
    seed: int = SEED,
    impute: bool = True,
    edges: list[list[float]] | None = None,
) -> Pipeline:
    """With ``edges`` (``bin_edges``) trees split between the given bins. Spark's trees else look for the thresholds
    in some 10,000 rows, maxBins squared if that is more; with bins for features they can see all rows."""
    options = dict(settings)
    kind = options.pop("kind")
    stages: list[Estimator] = []
    inputs = features
    if impute:
        inputs = [f"{f}_filled" for f in features]
        stages.append(Imputer(strategy="mean", inputCols=features, outputCols=inputs))
    if edges is not None:
        binned = [f"{f}_bin" for f in features]
        splits = [[-math.inf, *([x for x in lows if math.isfinite(x)] or [0.0]), math.inf] for lows in edges]
        stages.append(Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=binned, handleInvalid="keep"))
        inputs = binned
        options["maxBins"] = max(options.get("maxBins", MAX_BINS), max(map(len, splits)), math.isqrt(n_rows) + 1)
    raw = "raw_features" if kind == "linear" else "features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw))
    if kind == "linear":
        stages.append(
            StandardScaler(withMean=True, withStd=True, inputCol=raw, outputCol="features")
        )
        stages.append(
            LogisticRegression(regParam=1.0 / n_rows, elasticNetParam=0.0, standardization=False, **options)
        )
    elif kind == "forest":
        stages.append(RandomForestClassifier(seed=seed, **options))
    else:
        stages.append(GBTClassifier(seed=seed, **options))
    return Pipeline(stages=stages)


def side_by_side(spark: SparkSession, fits: list[Callable], cells: int = 0) -> list:
    """Run independent fits from a few threads, as the jobs of one leave cores idle. Fits on so many cells that each
    has tasks for all cores run one after the other: only one then keeps its rows in memory and on disk."""
    at_once = PARALLEL_FITS if cells <= TASK_CELLS * spark.sparkContext.defaultParallelism else 1
    with ThreadPool(min(at_once, len(fits))) as pool:
        return pool.map(lambda fit: inheritable_thread_target(spark)(fit)(), fits, chunksize=1)


def stored_for_fits(rows: DataFrame, features: list[str]) -> tuple[DataFrame, int]:
    """The rows settled in files of what a task takes, and their number: fits read them without a shuffle."""
    return settle(rows.hint("rebalance"), max(1, TASK_CELLS // len(features)))


def in_parts(rows: DataFrame, n_rows: int, features: list[str], settings: dict) -> DataFrame:
    """Stored rows in as many parts as a fit's passes need. Boosting makes a pass, two stages with a task for each
    part, for every level of every tree: with few rows its time is that of starting tasks. A forest grows its trees
    at once, so its parts are smaller; but each part hands on the sums of all nodes, and tasks of half a minute keep the
    short ones of other fits waiting, so two thirds of the cores are enough where the rows don't ask for more. Rows that lie in too few files for trees are dealt anew; the linear model, which would
    repeat that in every step, and rows in files enough for all cores are read as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    cells = n_rows * len(features)
    enough = max(2 * cores // 3, math.ceil(cells / TASK_CELLS))
    parts = min(math.ceil(cells * settings.get("numTrees", 1) / TASK_CELLS), enough)
    if settings["kind"] == "boost":
        parts = max(parts, min(cores // 2, math.ceil(cells / BOOST_CELLS)))
    have = rows.rdd.getNumPartitions()
    if parts <= have or have >= cores or settings["kind"] == "linear":
        return rows.coalesce(max(1, min(parts, have)))
    return rows.repartition(parts)


def fit(
    rows: DataFrame, features: list[str], settings: dict, n_rows: int, edges: list[list[float]] | None = None, **options
) -> PipelineModel:
    """Fit one model on stored rows, all of them, in parts of its own size (``in_parts``)."""
    return make_pipeline(features, settings, n_rows, edges=edges, **options).fit(in_parts(rows, n_rows, features, settings))


def edges_for(rows: DataFrame, features: list[str], models: list[dict]) -> Callable[[dict], list[list[float]] | None]:
    """The bin edges that each of the models needs, from one count of all rows; None for a model without bins."""
    bins = {s.get("maxBins", MAX_BINS) for s in models if s["kind"] != "linear"}
    found = bin_edges(rows, features, sorted(bins)) if bins else {}
    return lambda s: None if s["kind"] == "linear" else found[s.get("maxBins", MAX_BINS)]


def train(
    rows: DataFrame, features: list[str], models: dict[str, dict] = BATCH_MODELS, **options
) -> dict[str, PipelineModel]:
    """Fit every model of the set on all rows. They are stored, so that no pass carries the plan that made them."""
    stored, n = stored_for_fits(rows, features)
    edges = edges_for(stored, features, list(models.values()))
    fitted = side_by_side(
        rows.sparkSession,
        [lambda s=s: fit(stored, features, s, n, edges(s), **options) for s in models.values()],
        n * len(features),
    )
    return dict(zip(models, fitted))


def predict(model: PipelineModel, rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The class and the score of class 1 for each row."""
    columns = rows.columns if keep is None else keep
    scored = model.transform(rows)
    return scored.select(
        *columns,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


def cross_validate(
    rows: DataFrame,
    features: list[str],
    settings: dict,
    key: list[str],
    k: int = FOLDS,
    seed: int = SEED,
    **options,
) -> float:
    """Mean accuracy over k stratified folds, the model fitted anew for each."""
    folded, n_rows = stored_for_fits(stratified_folds(rows, "label", key, k, seed), features)

    def fold_accuracy(i: int) -> float:
        others = folded.where(F.col("fold") != i)
        model = fit(
            others, features, settings, others.count(), edges_for(others, features, [settings])(settings), seed=seed, **options
        )
        held = predict(model, folded.where(F.col("fold") == i), ["label"])
        return accuracy(held).first()["accuracy"]

    folds = [lambda i=i: fold_accuracy(i) for i in range(k)]
    scores = side_by_side(rows.sparkSession, folds, n_rows * len(features))
    return sum(scores) / k


def compare(
    models: dict[str, PipelineModel], test: DataFrame, cv: dict[str, float] | None = None
) -> DataFrame:
    """One row per model: position, model, accuracy, auc, and mean fold accuracy if given."""
    cached = test.persist()
    lines = []
    for i, (name, model) in enumerate(models.items()):
        held = predict(model, cached, ["label"]).persist()
        fold_mean = None if cv is None else cv.get(name)
        lines.append(
            (i, name, accuracy(held).first()["accuracy"], auc(held).first()["auc"], fold_mean)
        )
        held.unpersist()
    cached.unpersist()
    schema = "position int, model string, accuracy double, auc double, cv_accuracy double"
    return test.sparkSession.createDataFrame(lines, schema)


def comparison_text(comparison: DataFrame) -> DataFrame:
    """The comparison as display text, in model order."""
    return comparison.orderBy("position").select(
        "model",
        percent_text(F.col("accuracy") * 100, 2).alias("Accuracy"),
        fixed_text("auc", 4).alias("ROC-AUC"),
        percent_text(F.col("cv_accuracy") * 100, 2).alias("CV Accuracy"),
    )


def best_model(comparison: DataFrame) -> str:
    return best_row(comparison, "auc", "position").first()["model"]


def importance(
    spark: SparkSession, model: PipelineModel, features: list[str], k: int = 15
) -> DataFrame | None:
    """The k most important features; None for a model that has no importances."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return None
    weights = np.asarray(last.featureImportances.toArray())
    lines = [(i, f, float(w)) for i, (f, w) in enumerate(zip(features, weights))]
    table = spark.createDataFrame(lines, "position int, feature string, importance double")
    return top_k(table, "importance", k, ["position"])


def scenario_rows(scenarios: DataFrame, features: list[str]) -> DataFrame:
    """What-if learners as model input: a feature that is not given is 0, and the click
    deviation, unless given, follows the early clicks."""
    rows = scenarios
    if "click_std" in features and "click_std" not in rows.columns and "clicks_day30" in rows.columns:
        rows = rows.withColumn("click_std", F.col("clicks_day30") * F.lit(DEVIATION_SHARE))
    for f in features:
        given = F.col(f).cast("double") if f in rows.columns else F.lit(None).cast("double")
        rows = rows.withColumn(f, F.coalesce(given, F.lit(0.0)))
    return rows


def score_scenarios(
    models: dict[str, PipelineModel], scenarios: DataFrame, features: list[str], key: str = "scenario"
) -> DataFrame:
    """(scenario, model, prediction, pass_pct, risk_pct, error, verdict) for every model. A model that
    cannot take the scenarios reports class 0 and full risk, and why in ``error``."""
    rows = scenario_rows(scenarios, features)
    parts = []
    for name, model in models.items():
        try:
            scored = predict(model, rows, [key]).select(
                key,
                F.lit(name).alias("model"),
                "prediction",
                round_even(F.col("score") * 100, 1).alias("pass_pct"),
                round_even((1 - F.col("score")) * 100, 1).alias("risk_pct"),
                F.lit(None).cast("string").alias("error"),
            )
        except (AnalysisException, IllegalArgumentException) as refused:  # the others still answer
            scored = rows.select(
                key,
                F.lit(name).alias("model"),
                F.lit(0).alias("prediction"),
                F.lit(0.0).alias("pass_pct"),
                F.lit(100.0).alias("risk_pct"),
                F.lit(str(refused)).alias("error"),
            )
        parts.append(scored)
    verdict = F.when(F.col("prediction") == 1, "Pass").otherwise("At Risk")
    return reduce(DataFrame.unionByName, parts).withColumn("verdict", verdict)
