"""Median imputation of prices.

Null price -> median of the product -> median of the whole column, both over
the unfilled column.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from demandcast.operators.quantiles import exact_quantiles
from demandcast.schema import SERIES

PRICES = ("selling_price", "mrp", "price_volatility")


def any_null(columns) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def _long(daily: DataFrame, columns) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    return daily.select(*SERIES, F.explode(F.array(*pairs)).alias("pair")).select(
        *SERIES, "pair.*"
    )


def _wide(columns, name: str) -> list[Column]:
    return [
        F.max(F.when(F.col("column") == c, F.col("median"))).alias(name.format(c)) for c in columns
    ]


def series_medians(daily: DataFrame, columns=PRICES) -> DataFrame:
    """Product medians for each series that misses a value, as `_product_<column>`.

    Only products with a gap enter the median job. Rows are matched on the
    whole series key: matching on the product alone would gather a hot product
    in one task.
    """
    series = daily.groupBy(*SERIES).agg(F.max(any_null(columns).cast("int")).alias("_gap"))
    # One row per city of a product.
    product_gap = F.max("_gap").over(W.partitionBy("product_id"))
    gap_products = series.withColumn("_gap", product_gap).where("_gap = 1").select(*SERIES)
    medians = exact_quantiles(
        _long(daily, columns).join(gap_products, list(SERIES), "left_semi"),
        "value",
        {"median": 0.5},
        by=("product_id", "column"),
    )
    wide = medians.groupBy("product_id").agg(*_wide(columns, "_product_{}"))
    return series.where("_gap = 1").select(*SERIES).join(wide, "product_id", "left")


def column_medians(daily: DataFrame, columns=PRICES) -> DataFrame:
    """One row with the median of every column."""
    medians = exact_quantiles(
        _long(daily, columns), "value", {"median": 0.5}, by=("column",), few_groups=True
    )
    return medians.agg(*_wide(columns, "{}"))


def fill_gaps(
    daily: DataFrame, per_series: DataFrame, overall: DataFrame | None, columns=PRICES
) -> DataFrame:
    """Close the gaps; the join is on the keys that the series windows use anyway."""
    filled = daily.join(per_series, list(SERIES), "left")
    values = {c: [F.col(c), F.col(f"_product_{c}")] for c in columns}
    if overall is not None:
        row = overall.select(F.struct(*columns)).scalar()
        filled = filled.withColumn("_overall", row)
        for c in columns:
            values[c].append(F.col(f"_overall.{c}"))
    return filled.select(
        *[F.coalesce(*values[c]).alias(c) if c in columns else F.col(c) for c in daily.columns]
    )


def impute_median(daily: DataFrame, columns=PRICES) -> DataFrame:
    """Close all gaps. `daily` is read several times, so store it first."""
    per_series, overall = series_medians(daily, columns), column_medians(daily, columns)
    return fill_gaps(daily, per_series, overall, columns)
