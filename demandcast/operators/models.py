"""Spark ML regressors, stacking, selection and hyper-parameter search."""

import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from demandcast.operators.scoring import aligned
from demandcast.schema import FEATURES, SEED
from demandcast.session import scratch

GBT_DEFAULTS = {
    "maxIter": 40,
    "maxDepth": 5,
    "stepSize": 0.1,
    "maxBins": 64,
    "minInstancesPerNode": 20,
    "subsamplingRate": 0.8,
}
RF_DEFAULTS = {"numTrees": 40, "maxDepth": 8, "maxBins": 64, "minInstancesPerNode": 10}

# The ranges a search draws from, as (kind, low, high).
GBT_SPACE = {
    "stepSize": ("log", 0.01, 0.3),
    "maxDepth": ("int", 3, 12),
    "minInstancesPerNode": ("int", 10, 200),
    "featureSubsetStrategy": ("share", 0.6, 1.0),
    "subsamplingRate": ("float", 0.6, 1.0),
    "minInfoGain": ("float", 0.0, 1.0),
}
RF_SPACE = {"maxDepth": ("int", 4, 10), "maxBins": ("int", 32, 255)}

# Penalties of the stacking candidates, in order of preference.
META_PENALTIES = {
    "Ridge": (1.0, 0.0),
    "Lasso": (0.1, 1.0),
    "ElasticNet": (0.1, 0.5),
}
BASES = {"gbt": "pred_gbt", "rf": "pred_rf"}


def assemble(df: DataFrame, features=FEATURES) -> DataFrame:
    """Add the `features` vector; inputs are aligned first, columns stay as they are."""
    inputs = {f"_in_{f}": aligned(df, f) for f in features}
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features")
    return assembler.transform(df.withColumns(inputs)).drop(*inputs)


def fit_gbt(vectors: DataFrame, params=None, validation: str | None = None):
    """Boosted trees; rows flagged in `validation` decide when to stop."""
    settings = {**GBT_DEFAULTS, **(params or {})}
    model = GBTRegressor(
        labelCol="target", predictionCol="pred_gbt", seed=SEED, validationTol=1e-4, **settings
    )
    if validation:
        model = model.setValidationIndicatorCol(validation)
    return model.fit(vectors)


def fit_rf(vectors: DataFrame, params=None):
    settings = {**RF_DEFAULTS, **(params or {})}
    model = RandomForestRegressor(
        labelCol="target", predictionCol="pred_rf", seed=SEED, **settings
    )
    return model.fit(vectors)


def feature_importance(model, spark, features=FEATURES) -> DataFrame:
    """(feature, importance), most important first; shares add up to 1."""
    pairs = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    table = spark.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def top_features(importance: DataFrame, n: int = 25) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def meta_vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(BASES.values()), outputCol="meta_features").transform(df)


def penalty(alpha: float, l1_ratio: float, name: str, sigma: float, n: int) -> tuple[float, float]:
    """(regParam, elasticNetParam) with the given meaning of alpha.

    The solver scales the squared penalty by the label's population deviation;
    Ridge's alpha is for the sum of squares, the others' for the mean.
    """
    if name == "Ridge":
        return alpha * sigma / n, 0.0
    first, second = alpha * l1_ratio, alpha * (1 - l1_ratio) * sigma
    total = first + second
    return total, (first / total if total else 0.0)


def fit_meta_candidates(scored: DataFrame) -> dict:
    """One linear model per penalty, on base predictions and `target`."""
    sigma, n = scored.agg(F.stddev_pop("target"), F.count(F.lit(1))).first()
    rows = meta_vector(scored.select("target", *BASES.values()))
    candidates = {}
    for name, (alpha, l1_ratio) in META_PENALTIES.items():
        strength, mix = penalty(alpha, l1_ratio, name, sigma, n)
        candidates[name] = LinearRegression(
            featuresCol="meta_features",
            labelCol="target",
            predictionCol="pred_meta",
            standardization=False,
            regParam=strength,
            elasticNetParam=mix,
        ).fit(rows)
    return candidates


def meta_scores(scored: DataFrame, candidates: dict) -> DataFrame:
    """(ordinal, name, mae) of each candidate on the given rows, in one pass."""
    rows = meta_vector(scored.select("target", *BASES.values()))
    for name, model in candidates.items():
        rows = model.copy().setPredictionCol(f"_{name}").transform(rows)
    maes = rows.agg(
        *[F.avg(F.abs(F.col("target") - F.col(f"_{name}"))).alias(name) for name in candidates]
    )
    return maes.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ordinal"), F.lit(name).alias("name"), F.col(name).alias("mae")
                    )
                    for i, name in enumerate(candidates)
                ]
            )
        ).alias("row")
    ).select("row.*")


def select_meta(scores: DataFrame) -> DataFrame:
    """The candidate with the least MAE; the first one wins a tie."""
    return scores.orderBy("mae", "ordinal").limit(1)


def draw(space: dict, trials: int, seed: int = SEED) -> list[dict]:
    """Parameter sets drawn at random from the space."""
    source = random.Random(seed)

    def value(kind, low, high):
        if kind == "int":
            return source.randint(low, high)
        if kind == "log":
            return math.exp(source.uniform(math.log(low), math.log(high)))
        number = source.uniform(low, high)
        return f"{number:.3f}" if kind == "share" else number

    return [{k: value(*bounds) for k, bounds in space.items()} for _ in range(trials)]


def hyperparam_search(
    rows: DataFrame,
    family: str,
    trials: int = 4,
    space: dict | None = None,
    fixed: dict | None = None,
    parallelism: int = 2,
    seed: int = SEED,
) -> DataFrame:
    """(trial, fold, params, mae) for every drawn parameter set and fold.

    `rows` carry `fold`: fold k is tested on rows marked k after training on
    the rows marked lower. Vectors are stored once and read by every fit; fits run
    side by side, each one a Spark job.
    """
    with scratch(rows.sparkSession) as store:
        vectors = store(assemble(rows).select("fold", "target", "features"), "vectors")
        return _search(vectors, family, trials, space, fixed, parallelism, seed)


def _search(vectors, family, trials, space, fixed, parallelism, seed) -> DataFrame:
    folds = [r[0] for r in vectors.where("fold > 0").select("fold").distinct().collect()]
    default = GBT_SPACE if family == "gbt" else RF_SPACE
    drawn = draw(space or default, trials, seed)

    def run(job):
        trial, fold = job
        params = {**(fixed or {}), **drawn[trial]}
        seen = vectors.where(F.col("fold") <= fold).withColumn("is_valid", F.col("fold") == fold)
        train = seen.where(~F.col("is_valid"))
        model = fit_gbt(seen, params, "is_valid") if family == "gbt" else fit_rf(train, params)
        held_out = seen.where("is_valid")
        scored = model.setPredictionCol("prediction").transform(held_out)
        text = ", ".join(f"{k}={v}" for k, v in sorted(params.items()))
        error = F.avg(F.abs(F.col("target") - F.col("prediction")))
        return trial, fold, text, scored.agg(error).first()[0]

    jobs = [(trial, fold) for trial in range(trials) for fold in sorted(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(run, jobs))
    return vectors.sparkSession.createDataFrame(
        results, "trial int, fold int, params string, mae double"
    )


def best_trial(results: DataFrame) -> DataFrame:
    """The parameter set with the least mean error over its folds."""
    means = results.groupBy("trial", "params").agg(F.avg("mae").alias("mae"))
    return means.orderBy("mae", "trial").limit(1)


def drawn_params(
    results: DataFrame,
    family: str,
    trials: int,
    space: dict | None = None,
    fixed: dict | None = None,
    seed: int = SEED,
) -> dict:
    """The winning parameter set of a search made with the same arguments."""
    default = GBT_SPACE if family == "gbt" else RF_SPACE
    winner = best_trial(results).first()["trial"]
    return {**(fixed or {}), **draw(space or default, trials, seed)[winner]}
