"""From raw sales and inventory to the feature table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from demandcast.functions.calendar import calendar_columns, season
from demandcast.functions.prices import price_columns
from demandcast.operators.aggregate import daily_sales, inventory_stock, join_inventory
from demandcast.operators.clean import drop_outliers, nulls_for_nan
from demandcast.operators.encode import fit_vocabulary, label_encode
from demandcast.operators.impute import any_null, column_medians, fill_gaps, series_medians
from demandcast.operators.series import BLOCK_ROWS, series_features, zero_fill
from demandcast.schema import SERIES
from demandcast.session import materialize, scratch

@dataclass
class FeatureTable:
    """Feature rows and the label codes they use, both stored."""

    rows: DataFrame
    vocabulary: DataFrame


def daily_table(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Daily product-city rows with stock."""
    return join_inventory(daily_sales(sales), inventory_stock(inventory))


def fill_prices(daily: DataFrame, store=materialize) -> DataFrame:
    """Close price gaps of a stored daily table.

    Each step runs only if it is needed: the driver reads whether any price is
    missing, and then whether any product has no price at all. Price
    volatility has no gaps after the daily aggregate.
    """
    columns = ("selling_price", "mrp")
    if not daily.agg(F.bool_or(any_null(columns))).first()[0]:
        return daily
    per_series = store(series_medians(daily, columns), "medians")
    unpriced = any_null([f"_product_{c}" for c in columns])
    overall = None
    if per_series.agg(F.bool_or(unpriced)).first()[0]:
        overall = store(column_medians(daily, columns), "column-medians")
    return fill_gaps(daily, per_series, overall, columns)


def with_codes(daily: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Season and label codes, joined while rows are still narrow.

    Product and city codes come in on the whole series key, so a hot product is
    not gathered in one task however large the vocabulary is. A vocabulary stored
    by column lets Spark size every column's codes on their own; those of the four
    seasons are broadcast.
    """
    labelled = label_encode(
        daily.withColumn("season", season("date")),
        vocabulary,
        ("category", "sub_category", "season"),
    )
    codes = label_encode(daily.select(*SERIES).distinct(), vocabulary, SERIES)
    return labelled.join(codes, list(SERIES), "left")


def with_row_features(daily: DataFrame) -> DataFrame:
    """Calendar and price columns."""
    return daily.withColumns({**calendar_columns(), **price_columns()})


def with_features(daily: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns but the label codes. Targets keep their nulls."""
    return zero_fill(series_features(with_row_features(daily), block_rows))


def build_features(
    sales: DataFrame,
    inventory: DataFrame,
    vocabulary: DataFrame | None = None,
    pair: tuple[str, str] | None = None,
) -> FeatureTable:
    """Run the feature job and store its results.

    The daily table is stored for the length of the job: the raw input is
    scanned once for it, and once more for the outlier limit. A given `vocabulary` (when scoring with a
    trained model) is used as it is. With a (city, product) `pair` only its rows get
    features; the outlier limit, medians and codes still come from all rows.
    """
    sales, inventory = nulls_for_nan(sales), nulls_for_nan(inventory)
    with scratch(sales.sparkSession) as store:
        daily = store(daily_table(drop_outliers(sales), inventory), "daily")
        if vocabulary is None:
            seasoned = daily.withColumn("season", season("date"))
            vocabulary = materialize(fit_vocabulary(seasoned), "vocabulary", by="column")
        coded = with_codes(fill_prices(daily, store), vocabulary)
        if pair:
            coded = coded.where((F.col("city_name") == pair[0]) & (F.col("product_id") == pair[1]))
        # Stored, so that the blocks of a series don't lie in one task from the join on its key.
        rows = with_features(store(coded, "coded"))
        return FeatureTable(materialize(rows, "features"), vocabulary)
