"""Column names, table schemas and the fixed values of the forecasting model."""

from pyspark.sql import types as T

# Settings that decide which columns exist and what they mean.
HORIZONS = (1, 3, 7, 14, 30)
MAIN_HORIZON = 7
LAGS = (1, 2, 3, 7, 14, 21, 28, 35)
ROLLING_WINDOWS = (3, 7, 14, 28)
FREQUENCY_WINDOWS = (7, 14, 28)
OUTLIER_QUANTILE = 0.999
EPSILON = 1e-6
MIN_HISTORY = max(LAGS)
HOLDOUT_DAYS = 14
FOLDS = 5
SEED = 42

SERIES = ("product_id", "city_name")
DAILY_KEYS = (
    "date",
    "product_id",
    "product_name",
    "category",
    "sub_category",
    "city_name",
)
# One series may hold several rows per date (one per product label); these
# columns order them.
SERIES_ORDER = ("date", "product_name", "category", "sub_category")
ENCODED = ("product_id", "city_name", "category", "sub_category", "season")

SALES = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("city_name", T.StringType()),
        T.StructField("units_sold", T.DoubleType()),
        T.StructField("selling_price", T.DoubleType()),
        T.StructField("mrp", T.DoubleType()),
    ]
)

INVENTORY = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("city_name", T.StringType()),
        T.StructField("stock_quantity", T.DoubleType()),
    ]
)

LAG_FEATURES = tuple(f"lag_units_{k}" for k in LAGS) + tuple(
    f"lag_price_{k}" for k in LAGS
)
ROLLING_FEATURES = tuple(
    f"roll_{stat}_{w}"
    for w in ROLLING_WINDOWS
    for stat in ("mean", "std", "max", "min", "price_mean")
)
FREQUENCY_FEATURES = tuple(f"sale_frequency_{w}" for w in FREQUENCY_WINDOWS)

# The order in which a fitted model reads its inputs.
FEATURES = (
    tuple(f"{c}_enc" for c in ENCODED)
    + ("day_of_week", "day_of_month", "month", "quarter", "week_of_year")
    + ("is_weekend", "is_month_start", "is_month_end")
    + ("selling_price", "mrp", "price_margin", "price_ratio", "discount_percent")
    + ("price_volatility", "transaction_count", "stock_quantity")
    + ("expanding_mean", "expanding_std", "expanding_count")
    + ("trend_ratio_7_28", "trend_diff_7_28", "volatility_7")
    + LAG_FEATURES
    + ROLLING_FEATURES
    + FREQUENCY_FEATURES
)

TARGETS = tuple(f"target_t{h}" for h in HORIZONS)
PREDICTIONS = ("pred_gbt", "pred_rf", "pred_ensemble", "pred_meta")
METRICS = ("mae", "rmse", "mape_pct", "r2", "median_ae", "q90_ae")
