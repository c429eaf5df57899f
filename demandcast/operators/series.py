"""Row-based features of each product-city series.

Offsets count observed rows, not days. Every statistic of the past leaves the
current row out. All windows share one partitioning and one order, so Spark plans a
single exchange and a single sort for them.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from demandcast.schema import (
    EPSILON,
    FREQUENCY_WINDOWS,
    HORIZONS,
    LAGS,
    MAIN_HORIZON,
    ROLLING_WINDOWS,
    SERIES,
    SERIES_ORDER,
    TARGETS,
)

VOLATILITY_WINDOW = 7
BLOCK_ROWS = 50_000
PAST_ROWS = max(*LAGS, *ROLLING_WINDOWS, *FREQUENCY_WINDOWS)
FUTURE_ROWS = max(HORIZONS)


def _bounded_columns(order) -> dict:
    """Columns that look at most PAST_ROWS back and FUTURE_ROWS ahead."""

    def past(rows):
        return order.rowsBetween(-rows, -1)

    columns = {}
    for k in LAGS:
        columns[f"lag_units_{k}"] = F.lag("units_sold", k).over(order)
        columns[f"lag_price_{k}"] = F.lag("selling_price", k).over(order)
    for rows in ROLLING_WINDOWS:
        columns[f"roll_mean_{rows}"] = F.avg("units_sold").over(past(rows))
        columns[f"roll_std_{rows}"] = F.stddev_samp("units_sold").over(past(rows))
        columns[f"roll_max_{rows}"] = F.max("units_sold").over(past(rows))
        columns[f"roll_min_{rows}"] = F.min("units_sold").over(past(rows))
        columns[f"roll_price_mean_{rows}"] = F.avg("selling_price").over(past(rows))
    for rows in FREQUENCY_WINDOWS:
        columns[f"sale_frequency_{rows}"] = F.avg("sold_flag").over(past(rows))
    week = past(VOLATILITY_WINDOW)
    columns["volatility_7"] = F.when(
        F.count("units_sold").over(week) >= 2,
        F.try_divide(
            F.stddev_pop("units_sold").over(week),
            F.avg("units_sold").over(week) + F.lit(EPSILON),
        ),
    )
    for h in HORIZONS:
        columns[f"target_t{h}"] = F.lead("units_sold", h).over(order)
        columns[f"target_date_t{h}"] = F.lead("date", h).over(order)
    return columns


def series_positions(daily: DataFrame) -> DataFrame:
    """Add `_row`, the 1-based row number within the series, `series_rows`, and
    `_level`, the units of the series' first row.

    Rows are counted per series and date first; only those counts (one per
    calendar day) are accumulated over a series.
    """
    days = daily.groupBy(*SERIES, "date").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by("units_sold", F.struct(*SERIES_ORDER[1:])).alias("_units"),
    )
    series = W.partitionBy(*SERIES)
    earlier = series.orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(
        *SERIES,
        "date",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_earlier"),
        F.sum("_rows").over(series).alias("series_rows"),
        F.coalesce(F.first("_units").over(series.orderBy("date")), F.lit(0.0)).alias("_level"),
    )
    same_day = W.partitionBy(*SERIES, "date").orderBy(*SERIES_ORDER[1:])
    return (
        daily.join(days, [*SERIES, "date"])
        .withColumn("_row", F.col("_earlier") + F.row_number().over(same_day))
        .drop("_earlier")
    )


def _in_blocks(df: DataFrame, block_rows: int) -> DataFrame:
    """All columns, with each series cut into blocks of `block_rows` rows.

    A block also receives copies of the neighbouring rows that its lags, rolls
    and targets can see; what the expanding columns need from earlier blocks
    comes from block totals. No task holds more than one block, its borders,
    and the totals of one series.

    Sums and squares are taken of the distance from the series' first units, so
    that large values don't cancel. Rows that come later change nothing, not even
    the last digit of a row's statistics.
    """
    if block_rows <= max(PAST_ROWS, FUTURE_ROWS):
        raise ValueError("a block must be longer than the longest look-back")
    placed = series_positions(df)
    distance = F.col("units_sold") - F.col("_level")
    offset = (F.col("_row") - 1) % block_rows
    home = F.floor((F.col("_row") - 1) / block_rows)
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= block_rows - PAST_ROWS, home + 1),
            F.when((offset < FUTURE_ROWS) & (home > 0), home - 1),
        )
    )
    blocks = placed.withColumn("_home", home).withColumn("_block", F.explode(copies))

    totals = placed.groupBy(*SERIES, home.alias("_block")).agg(
        F.sum(distance).alias("_sum"),
        F.sum(distance * distance).alias("_squares"),
    )
    earlier = W.partitionBy(*SERIES).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *SERIES,
        "_block",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum"),
        F.coalesce(F.sum("_squares").over(earlier), F.lit(0.0)).alias("_squares"),
    )

    order = W.partitionBy(*SERIES, "_block").orderBy("_row")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    own = F.when(F.col("_block") == F.col("_home"), distance)
    n = F.col("_row") - 1
    total = F.col("_sum") + F.coalesce(F.sum(own).over(before), F.lit(0.0))
    squares = F.col("_squares") + F.coalesce(F.sum(own * own).over(before), F.lit(0.0))
    spread = F.greatest(squares - F.try_divide(total * total, n), F.lit(0.0))
    return (
        blocks.join(totals, [*SERIES, "_block"])
        .withColumns(
            {
                **_bounded_columns(order),
                "expanding_mean": F.col("_level") + F.try_divide(total, n),
                "expanding_std": F.when(n >= 2, F.sqrt(F.try_divide(spread, n - 1))),
                "expanding_count": F.col("_row"),
            }
        )
        .where(F.col("_block") == F.col("_home"))
        .drop("_block", "_home", "_row", "_sum", "_squares", "_level")
    )


def series_features(daily: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lag, rolling, expanding, frequency, volatility and target columns.

    Nothing is filled here. Every series takes the same path: it is cut into
    blocks of `block_rows` rows, so one of any length is spread over many tasks.
    The length of a block changes no result. `daily` should be stored or come from
    a scan: rows that come out of a join on the series key would already lie with
    a whole series in one task.
    """
    flagged = daily.withColumn("sold_flag", (F.col("units_sold") > 0).cast("int"))
    out = _in_blocks(flagged, block_rows)
    out = out.withColumn("target", F.col(f"target_t{MAIN_HORIZON}"))
    week, month = F.col("roll_mean_7"), F.col("roll_mean_28")
    return out.withColumns(
        {
            "trend_ratio_7_28": F.coalesce(
                F.try_divide(week, month + F.lit(EPSILON)), F.lit(1.0)
            ),
            "trend_diff_7_28": F.coalesce(week - month, F.lit(0.0)),
        }
    )


def zero_fill(df: DataFrame) -> DataFrame:
    """Null numbers become 0, except in the targets."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    kept = (*TARGETS, "target", *SERIES, *SERIES_ORDER)
    return df.select(
        *[
            F.coalesce(F.col(name), F.lit(0).cast(kind)).alias(name)
            if kind in kinds and name not in kept
            else F.col(name)
            for name, kind in df.dtypes
        ]
    )
