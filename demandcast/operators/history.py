"""Look-ups in the sales history of product-city pairs."""

from pyspark.sql import DataFrame, Window as W, functions as F

from demandcast.schema import SERIES, SERIES_ORDER

PREVIEW_ROWS = 10


def pair_history(df: DataFrame, city: str, product: str) -> DataFrame:
    """Rows of one city and product; both filters reach the scan."""
    return df.where((F.col("city_name") == city) & (F.col("product_id") == str(product)))


def recent_history(
    df: DataFrame, rows: int = PREVIEW_ROWS, ties: tuple[str, ...] = SERIES_ORDER[1:]
) -> DataFrame:
    """Latest `rows` rows of every pair, numbered in `recency` from 1.

    The filter on row_number lets Spark keep only `rows` rows per pair before
    the shuffle, so a hot pair is cut down in every input task.
    """
    newest = W.partitionBy(*SERIES).orderBy(
        F.col("date").desc(), *[F.col(c).desc() for c in ties]
    )
    return df.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= rows)


def latest_per_pair(df: DataFrame, ties: tuple[str, ...] = SERIES_ORDER[1:]) -> DataFrame:
    """The last row of every pair by date."""
    return recent_history(df, 1, ties).drop("recency")
