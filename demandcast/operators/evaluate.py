"""Error metrics and the tables behind diagnostic plots."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from demandcast.operators.quantiles import exact_quantiles

HISTOGRAM_BINS = 50


def unpivot_predictions(df: DataFrame, truth: str, models: dict[str, str]) -> DataFrame:
    """(model, y, prediction): one row per input row and model."""
    return df.select(
        F.col(truth).cast("double").alias("y"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(model).alias("model"),
                        F.col(column).cast("double").alias("prediction"),
                    )
                    for model, column in models.items()
                ]
            )
        ).alias("pair"),
    ).select("pair.*", "y")


def regression_metrics(df: DataFrame, truth: str, models: dict[str, str]) -> DataFrame:
    """One row per model: mae, rmse, mape_pct, r2, median_ae, q90_ae.

    MAPE leaves out rows whose true value is 0 and is infinite when no row is
    left. A constant truth gives r2 1 for a perfect prediction, else 0.
    """
    long = unpivot_predictions(df, truth, models).withColumn(
        "error", F.col("y") - F.col("prediction")
    )
    long = long.withColumn("abs_error", F.abs("error"))
    residual = F.sum(F.col("error") * F.col("error"))
    total = F.var_pop("y") * F.count("y")
    sums = long.groupBy("model").agg(
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.coalesce(
            F.avg(F.when(F.col("y") != 0, F.try_divide("abs_error", F.abs("y")))) * 100,
            F.lit(float("inf")),
        ).alias("mape_pct"),
        F.when(total == 0, F.when(residual == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.try_divide(residual, total))
        .alias("r2"),
    )
    middle = exact_quantiles(
        long, "abs_error", {"median_ae": 0.5, "q90_ae": 0.9}, by=("model",), few_groups=True
    )
    return sums.join(middle, "model")


def daily_error(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.groupBy("date").agg(
        F.avg(F.abs(F.col(truth) - F.col(prediction))).alias("mean_abs_error")
    )


def residual_histogram(
    df: DataFrame, truth: str, prediction: str, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width bins from the least to the greatest residual, last one closed.

    All-equal residuals get a range of width 1 around them.
    """
    residuals = df.select((F.col(truth) - F.col(prediction)).alias("residual")).dropna()
    ends = residuals.agg(
        F.struct(F.min("residual").alias("low"), F.max("residual").alias("high"))
    ).scalar()
    flat = F.col("_ends.low") == F.col("_ends.high")
    low = F.when(flat, F.col("_ends.low") - 0.5).otherwise(F.col("_ends.low"))
    high = F.when(flat, F.col("_ends.high") + 0.5).otherwise(F.col("_ends.high"))
    width = (high - low) / bins
    counted = (
        residuals.withColumn("_ends", ends)
        .select(
            F.least(F.floor((F.col("residual") - low) / width), F.lit(bins - 1))
            .cast("int")
            .alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    edges = (
        df.sparkSession.range(bins)
        .withColumn("_ends", ends)
        .select(
            F.col("id").cast("int").alias("bin"),
            (low + F.col("id") * width).alias("bin_start"),
            (low + (F.col("id") + 1) * width).alias("bin_end"),
        )
    )
    # One row per bin on both sides.
    return edges.join(F.broadcast(counted), "bin", "left").withColumn(
        "count", F.coalesce("count", F.lit(0))
    )


def blend_weights(df: DataFrame, truth: str, models: dict[str, str]) -> DataFrame:
    """(model, mae, weight): weights go with 1/MAE (1 if the MAE is 0) and add up to 1."""
    mae = [F.avg(F.abs(F.col(truth) - F.col(c))).alias(m) for m, c in models.items()]
    raw = {m: F.when(F.col(m) > 0, F.try_divide(F.lit(1.0), F.col(m))).otherwise(1.0) for m in models}
    total = reduce(lambda a, b: a + b, raw.values())
    return (
        df.agg(*mae)
        .select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(m).alias("model"),
                            F.col(m).alias("mae"),
                            (raw[m] / total).alias("weight"),
                        )
                        for m in models
                    ]
                )
            ).alias("row")
        )
        .select("row.*")
    )


def weighted_ensemble(
    df: DataFrame, truth: str, models: dict[str, str], name: str = "pred_ensemble"
) -> DataFrame:
    """Add the 1/MAE-weighted blend of the given prediction columns."""
    weights = (
        blend_weights(df, truth, models)
        .agg(F.map_from_entries(F.collect_list(F.struct("model", "weight"))))
        .scalar()
    )
    blend = reduce(
        lambda a, b: a + b,
        [F.element_at("_weights", m) * F.col(c) for m, c in models.items()],
    )
    return df.withColumn("_weights", weights).withColumn(name, blend).drop("_weights")


def prediction_pairs(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """True value, prediction and residual of each row."""
    return df.select(
        F.col(truth).alias("true"),
        F.col(prediction),
        (F.col(truth) - F.col(prediction)).alias("residual"),
    )
