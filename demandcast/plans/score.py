"""Scoring whole tables and the newest row of every pair."""

from pyspark.sql import DataFrame, functions as F

from demandcast.operators.history import latest_per_pair
from demandcast.plans.train import Forecaster
from demandcast.schema import PREDICTIONS


def batch_score(df: DataFrame, forecaster: Forecaster) -> DataFrame:
    """The input columns plus pred_gbt, pred_rf and pred_final.

    Row by row: no shuffle, and the same code scores a stream.
    """
    scored = forecaster.predict(df)
    added = [c for c in ("pred_gbt", "pred_rf", "pred_final") if c in scored.columns]
    return scored.select(*[c for c in df.columns if c not in added], *added)


def forecast_latest(features: DataFrame, forecaster: Forecaster) -> DataFrame:
    """One forecast per city and product from its newest feature row."""
    scored = forecaster.predict(latest_per_pair(features))
    bases = [c for c in PREDICTIONS[:2] if c in scored.columns]
    return scored.select(
        F.col("city_name").alias("city"),
        F.col("product_id").alias("product"),
        F.col("pred_final").alias("predicted_units_next_7d"),
        *bases,
    )
