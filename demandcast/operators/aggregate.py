"""Daily sales, stock levels and table summaries."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from demandcast.schema import DAILY_KEYS, SERIES


def daily_sales(sales: DataFrame) -> DataFrame:
    """One row per date, product (with its labels) and city.

    Rows with a null key are dropped. Partial aggregation collapses a hot
    product or city before the shuffle.
    """
    return (
        sales.dropna(subset=list(DAILY_KEYS))
        .groupBy(*DAILY_KEYS)
        .agg(
            F.coalesce(F.sum("units_sold"), F.lit(0.0)).alias("units_sold"),
            F.count("units_sold").alias("transaction_count"),
            F.avg("selling_price").alias("selling_price"),
            F.coalesce(F.stddev_samp("selling_price"), F.lit(0.0)).alias("price_volatility"),
            F.min("selling_price").alias("min_price"),
            F.max("selling_price").alias("max_price"),
            F.avg("mrp").alias("mrp"),
            F.stddev_samp("mrp").alias("mrp_std"),
        )
    )


def inventory_stock(inventory: DataFrame) -> DataFrame:
    """Total stock per product and city; rows without an id match nothing."""
    return (
        inventory.dropna(subset=list(SERIES))
        .groupBy(*SERIES)
        .agg(F.coalesce(F.sum("stock_quantity"), F.lit(0.0)).alias("stock_quantity"))
    )


def join_inventory(daily: DataFrame, stock: DataFrame) -> DataFrame:
    """Attach stock to every day of a series, 0 where there is none.

    The join keys are the series keys, so a shuffled join leaves the rows
    partitioned as the series windows need them.
    """
    joined = daily.join(stock, list(SERIES), "left")
    return joined.withColumn("stock_quantity", F.coalesce("stock_quantity", F.lit(0.0)))


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and date range of each named table."""
    parts = []
    for name, df in tables.items():
        date = F.col("date") if "date" in df.columns else F.lit(None).cast("date")
        parts.append(
            df.agg(
                F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.min(date).alias("min_date"),
                F.max(date).alias("max_date"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def target_stats(rows: DataFrame, target: str = "target") -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"),
        F.min(target).alias("min"),
        F.max(target).alias("max"),
    )


def dim_values(df: DataFrame, columns=("city_name", "product_id")) -> DataFrame:
    """Distinct non-null values per column, in order, from one pass."""
    pairs = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), F.col(c).cast("string").alias("value")
                    )
                    for c in columns
                ]
            )
        ).alias("pair")
    ).select("pair.*")
    return pairs.dropna(subset=["value"]).distinct().orderBy("column", "value")
