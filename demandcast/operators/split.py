"""Row selection for training, holdout split and forward-chaining folds."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from demandcast.operators.ordering import preceding_total
from demandcast.operators.series import series_positions
from demandcast.schema import FEATURES, FOLDS, HOLDOUT_DAYS, MIN_HISTORY, SERIES


def min_history(df: DataFrame, rows: int = MIN_HISTORY) -> DataFrame:
    """Keep series with more than `rows` rows."""
    if "series_rows" not in df.columns:
        long = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_rows"))
        return df.join(long.where(F.col("_rows") > rows), list(SERIES), "left_semi")
    return df.where(F.col("series_rows") > rows)


def model_rows(features: DataFrame, target: str = "target") -> DataFrame:
    """Rows a model may learn from: long series, target known."""
    return min_history(features).dropna(subset=[target])


def feature_matrix(df: DataFrame, keep=(*SERIES, "date"), label: str = "target") -> DataFrame:
    """Keys, the model inputs that exist in `df` (in model order), and the label."""
    present = [c for c in FEATURES if c in df.columns]
    return df.select(*keep, *present, label)


def cutoff_date(df: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> Column:
    """Scalar subquery: latest date minus the holdout, in calendar days."""
    return df.agg(F.date_sub(F.max("date"), holdout_days)).scalar()


def holdout_split(df: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """Add `split`: 'train' up to the cutoff date, 'test' after it."""
    return df.withColumn(
        "split",
        F.when(F.col("date") <= cutoff_date(df, holdout_days), "train").otherwise("test"),
    )


def _fold(position: Column, n: Column, folds: int) -> Column:
    """Test fold (1..folds) of a 0-based position; 0 is never tested."""
    size = F.floor(n / (folds + 1))
    first = n - size * folds
    return F.when(position < first, F.lit(0)).otherwise(
        F.floor(F.try_divide(position - first, size)).cast("int") + 1
    )


def folds_by_position(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Add `position` and `fold` over rows in product, city, date order.

    Fold k is tested on the rows marked k and trained on all rows marked lower.
    A row's position is the number of rows in earlier series plus its place in
    its own series.
    """
    placed = series_positions(df.drop("series_rows"))
    lengths = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_rows"))
    starts = preceding_total(lengths, list(SERIES), "_rows", "_start").drop("_rows")
    n = df.agg(F.count(F.lit(1))).scalar()
    position = F.col("_start") + F.col("_row") - 1
    out = placed.join(starts, list(SERIES)).withColumn("position", position)
    return out.withColumn("fold", _fold(F.col("position"), n, folds)).drop(
        "_start", "_row", "series_rows"
    )


def folds_by_date(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Add `fold` over distinct dates, so that no fold learns from its future."""
    dates = df.select("date").distinct()
    # One row per calendar day: bounded, so one ordered group is enough.
    ranked = dates.select(
        "date",
        (F.row_number().over(W.orderBy("date")) - 1).alias("_position"),
        F.count(F.lit(1)).over(W.partitionBy()).alias("_dates"),
    )
    marked = ranked.select("date", _fold(F.col("_position"), F.col("_dates"), folds).alias("fold"))
    return df.join(F.broadcast(marked), "date")
