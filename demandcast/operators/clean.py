"""Header, date and outlier clean-up of raw tables."""

from pyspark.sql import DataFrame, functions as F

from demandcast.functions.text import normal_header
from demandcast.operators.quantiles import exact_quantiles
from demandcast.schema import OUTLIER_QUANTILE


def normalize_columns(df: DataFrame) -> DataFrame:
    """Headers trimmed, in lower case, with spaces as underscores."""
    return df.toDF(*[normal_header(c) for c in df.columns])


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column."""
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def parse_dates(df: DataFrame, date_format: str, column: str = "date") -> DataFrame:
    """Text to date; rows whose text does not fit the format are dropped."""
    parsed = F.try_to_timestamp(F.col(column), F.lit(date_format)).cast("date")
    return df.withColumn(column, parsed).dropna(subset=[column])


def drop_outliers(
    df: DataFrame, column: str = "units_sold", quantile: float = OUTLIER_QUANTILE
) -> DataFrame:
    """Keep rows at or below the exact quantile; nulls go too."""
    limit = exact_quantiles(df, column, {"limit": quantile}).scalar()
    return df.where(F.col(column) <= limit)
