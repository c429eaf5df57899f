"""Models, label codes, feature list and reports on storage."""

import logging

from pyspark.ml.regression import (
    GBTRegressionModel,
    LinearRegressionModel,
    RandomForestRegressionModel,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from demandcast.plans.train import Forecaster, Training
from demandcast.operators.evaluate import daily_error, prediction_pairs, residual_histogram
from demandcast.operators.models import feature_importance

KINDS = {"gbt": GBTRegressionModel, "rf": RandomForestRegressionModel, "meta": LinearRegressionModel}
STAMP = "yyyyMMdd_HHmmss"

log = logging.getLogger(__name__)


def stamped(spark: SparkSession, folder: str, stem: str) -> str:
    """`folder/stem_<date>_<time>`, by the session's clock."""
    now = spark.range(1).select(F.date_format(F.current_timestamp(), STAMP)).first()[0]
    return f"{folder}/{stem}_{now}"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_forecasts(df: DataFrame, folder: str, stem: str = "predictions") -> str:
    """Forecast rows as CSV under a time-stamped name, which is returned."""
    path = stamped(df.sparkSession, folder, stem)
    write_csv(df, path)
    return path


def save_features(spark: SparkSession, features, path: str) -> None:
    rows = spark.createDataFrame(list(enumerate(features)), "ordinal int, feature string")
    rows.coalesce(1).write.mode("overwrite").json(path)


def load_features(spark: SparkSession, path: str) -> tuple[str, ...]:
    rows = spark.read.schema("ordinal int, feature string").json(path).orderBy("ordinal")
    return tuple(r["feature"] for r in rows.collect())


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """One folder per encoded column, so a reader of one column scans just that."""
    vocabulary.write.mode("overwrite").partitionBy("column").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, code int, column string").parquet(path)


def save_forecaster(spark: SparkSession, forecaster: Forecaster, folder: str) -> None:
    for name in KINDS:
        model = getattr(forecaster, name)
        if model is not None:
            model.write().overwrite().save(f"{folder}/{name}")
    save_features(spark, forecaster.features, f"{folder}/feature_list")
    weights = list(forecaster.weights.items())
    spark.createDataFrame(weights, "model string, weight double").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{folder}/weights")


def load_model(kind, path: str):
    """The model, or None with a logged error when it cannot be read."""
    try:
        return kind.load(path)
    except Exception as error:
        log.error("failed to load %s: %s", path, str(error).splitlines()[0])
        return None


def load_forecaster(spark: SparkSession, folder: str) -> Forecaster:
    """Whatever models the folder holds; the feature list must be there."""
    features = load_features(spark, f"{folder}/feature_list")
    models = {name: load_model(kind, f"{folder}/{name}") for name, kind in KINDS.items()}
    rows = spark.read.schema("model string, weight double").json(f"{folder}/weights").collect()
    return Forecaster(**models, weights=dict(map(tuple, rows)), features=features)


def write_reports(training: Training, vocabulary: DataFrame, folder: str) -> None:
    """Everything a training run leaves behind."""
    spark = vocabulary.sparkSession
    save_forecaster(spark, training.forecaster, folder)
    save_vocabulary(vocabulary, f"{folder}/vocabulary")
    importance = feature_importance(training.forecaster.gbt, spark, training.forecaster.features)
    write_csv(importance, f"{folder}/feature_importance")
    write_csv(training.predictions(), f"{folder}/test_predictions_summary")
    training.metrics().write.mode("overwrite").json(f"{folder}/metrics_summary")
    write_diagnostics(training.predictions(), folder)


def write_diagnostics(predictions: DataFrame, folder: str, prediction: str = "pred_meta") -> None:
    """The tables behind the plots of a run: error by day, residuals in bins, true against predicted."""
    write_csv(daily_error(predictions, "true", prediction), f"{folder}/daily_error")
    write_csv(residual_histogram(predictions, "true", prediction), f"{folder}/residual_histogram")
    write_csv(prediction_pairs(predictions, "true", prediction), f"{folder}/prediction_pairs")
