"""Spark queries over the given tables, one per operator."""

import uuid

from pyspark.sql import functions as F

from checks.duckdb_sql import CENT, HOLDOUT, METRIC_NAMES, MICRO, PRICE_COLUMNS, UNIT_STATISTICS, WINDOW_COLUMNS
from checks.rounding import rounded
from demandcast.operators import (
    aggregate,
    boosting,
    clean,
    dates,
    encode,
    evaluate,
    history,
    impute,
    models,
    scoring,
    split,
)
from demandcast.operators.series import series_features, zero_fill
from demandcast.plans.boosted import search_boosted, train_boosted
from demandcast.plans.features import build_features, with_features
from demandcast.plans.jobs import FOLDS, TRIALS
from demandcast.plans.score import batch_score, forecast_latest
from demandcast.plans.train import train_forecaster
from demandcast.schema import (
    DAILY_KEYS,
    ENCODED,
    FEATURES,
    FREQUENCY_WINDOWS,
    HORIZONS,
    LAGS,
    ROLLING_WINDOWS,
)
from demandcast.session import materialize, shared_folder
from demandcast.sources.star import star_inventory, star_sales

KEYS = ("date", "product_id", "city_name")
SALES_TIES = ("product_name", "category", "sub_category", "units_sold", "selling_price", "mrp")
NAIVE = {"lag": "pred_lag", "roll": "pred_roll"}


def comparable(df, *names):
    """`names` of `df` with prices and statistics rounded for comparison."""
    out = df.select(*names)
    out = rounded(out, CENT, *[n for n in names if n in PRICE_COLUMNS])
    return rounded(out, MICRO, *[n for n in names if n in UNIT_STATISTICS])


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def daily(spark, folder):
    return aggregate.daily_sales(star_sales(spark, folder))


def joined(spark, folder):
    stock = aggregate.inventory_stock(star_inventory(spark, folder))
    return aggregate.join_inventory(daily(spark, folder), stock)


_built = {}


def feature_table(spark, folder):
    """The stored feature table, built once per application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _built:
        _built[key] = build_features(star_sales(spark, folder), star_inventory(spark, folder))
    return _built[key]


def rows_for_models(spark, folder):
    return split.model_rows(feature_table(spark, folder).rows)


def naive(spark, folder):
    marked = split.holdout_split(rows_for_models(spark, folder), HOLDOUT)
    return marked.where(F.col("split") == "test").withColumns(
        {"pred_lag": F.col("lag_units_7"), "pred_roll": F.col("roll_mean_7")}
    )


def window_query(*names):
    # Stored, as the windows want their input: it is read twice, and its series aren't in one task.
    return lambda spark, folder: comparable(
        with_features(materialize(joined(spark, folder), "joined")), *KEYS, *names
    )


def scan_sales(spark, folder):
    sales = star_sales(spark, folder)
    return comparable(sales, *sales.columns)


def normalize_columns(spark, folder):
    part = table(spark, folder, "part")
    raw = part.toDF(*[f" {name.replace('_', ' ').upper()}  " for name in part.columns])
    return clean.normalize_columns(raw)


def parse_dates(spark, folder):
    status, text = F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(status == "O", text).when(status == "P", "").otherwise("not a date").alias("date"),
    )
    return clean.parse_dates(raw, "yyyy-MM-dd")


def mixed_dates(spark, folder):
    """Order dates as text: month first, ISO, day first or none, by priority and status."""
    priority, day = F.substring("o_orderpriority", 1, 1), F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "P", "")
        .when(priority == "1", F.date_format(day, "yyyy-MM-dd"))
        .when(priority == "2", F.date_format(day, "dd.MM.yyyy"))
        .when(priority == "3", "soon")
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
    )
    return table(spark, folder, "orders").select("o_orderkey", text.alias("date"))


def date_formats(spark, folder):
    return dates.date_formats(mixed_dates(spark, folder), "date", ("o_orderkey",))


def infer_dates(spark, folder):
    rows, _ = dates.parse_inferred(mixed_dates(spark, folder), ("o_orderkey",), rule="most")
    return rows


def date_quarantine(spark, folder):
    _, bad = dates.parse_inferred(mixed_dates(spark, folder), ("o_orderkey",))
    return bad


def outlier_filter(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.drop_outliers(lines, "l_extendedprice")


def daily_sales(spark, folder):
    out = daily(spark, folder)
    return comparable(out, *out.columns)


def impute_median(spark, folder):
    gappy = daily(spark, folder).withColumns(
        {
            "selling_price": F.when(F.col("transaction_count") <= 1, F.col("selling_price")),
            "mrp": F.when(F.col("category") != "CAT0", F.col("mrp")),
        }
    )
    stored = materialize(gappy, "gappy")
    return comparable(impute.impute_median(stored), *KEYS, "selling_price", "mrp")


def data_profile(spark, folder):
    return aggregate.table_profile(
        {
            "sales": star_sales(spark, folder),
            "inventory": star_inventory(spark, folder),
            "daily": daily(spark, folder),
        }
    )


def feature_blocks(spark, folder):
    """Series cut into blocks of 64 rows: the length of a block changes nothing."""
    names = [c for c in WINDOW_COLUMNS if c in FEATURES]
    blocks = zero_fill(series_features(joined(spark, folder), block_rows=64))
    return comparable(blocks, *KEYS, *names, "series_rows", "target")


def unseen_labels(spark, folder):
    """All daily rows coded with a vocabulary that was fitted without one brand."""
    rows = daily(spark, folder)
    known = encode.fit_vocabulary(rows.where("product_id <> 'Brand#12'"), ("product_id",))
    return encode.label_encode(rows, known, ("product_id",)).select(*KEYS, "product_id_enc")


def expanding_shifted(spark, folder):
    """Expanding statistics of units a thousand million higher, in short blocks, held against plain ones."""
    names = ("expanding_mean", "expanding_std", "expanding_count")
    rows = joined(spark, folder)
    high = rows.withColumn("units_sold", F.col("units_sold") + 1e9)
    high = series_features(high, block_rows=64).select(*KEYS, *[F.col(n).alias(f"high_{n}") for n in names])
    both = series_features(rows).select(*KEYS, *names).join(high, list(KEYS))
    first = F.col("expanding_count") == 1
    return both.select(
        *KEYS,
        "expanding_count",
        (first | (F.abs(F.col("high_expanding_mean") - 1e9 - F.col("expanding_mean")) < 1e-5)).alias("same_mean"),
        (
            (F.col("expanding_count") <= 2)
            | (F.abs(F.col("high_expanding_std") - F.col("expanding_std")) <= 1e-6 * (1 + F.col("expanding_std")))
        ).alias("same_std"),
    )


def feature_matrix(spark, folder):
    matrix = split.feature_matrix(rows_for_models(spark, folder))
    return comparable(matrix, *matrix.columns)


def feature_catalog(spark, folder):
    rows = rows_for_models(spark, folder)
    counts = rows.agg(*[F.count(f).alias(f) for f in FEATURES])
    # One row in, one row per feature out.
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ordinal"),
                        F.lit(f).alias("feature"),
                        F.col(f).alias("value_count"),
                    )
                    for i, f in enumerate(FEATURES)
                ]
            )
        ).alias("row")
    ).select("row.*")


def cv_folds(spark, folder):
    folds = split.folds_by_position(rows_for_models(spark, folder))
    return folds.select(*KEYS, "position", "fold")


def target_stats(spark, folder):
    return rounded(aggregate.target_stats(rows_for_models(spark, folder)), MICRO, "mean", "std")


def weighted_ensemble(spark, folder):
    out = evaluate.weighted_ensemble(naive(spark, folder), "target", NAIVE)
    out = out.select(*KEYS, "target", "pred_lag", "pred_roll", "pred_ensemble")
    return rounded(rounded(out, MICRO, "pred_roll"), CENT, "pred_ensemble")


def recent_history(spark, folder):
    out = history.recent_history(star_sales(spark, folder), 10, SALES_TIES)
    return comparable(out, *out.columns)


def latest_per_pair(spark, folder):
    out = history.latest_per_pair(star_sales(spark, folder), SALES_TIES)
    return comparable(out, *out.columns)


def pair_history(spark, folder):
    out = history.pair_history(star_sales(spark, folder), "ASIA", "Brand#12")
    return comparable(out, *out.columns)


def align_features(spark, folder):
    """Raw sales as scoring rows: most inputs missing, one of them dirty text."""
    sales = star_sales(spark, folder).withColumns(
        {
            "text_id": F.col("product_id").try_cast("double").isNull(),
            "stock_quantity": F.when(F.col("category") == "CAT1", "n/a").otherwise(
                F.col("units_sold").cast("string")
            ),
        }
    )
    out = scoring.align_features(sales, keep=("date", "city_name", "text_id"))
    return rounded(out, CENT, "selling_price", "mrp")


def explain_prompt(spark, folder):
    forecasts = history.latest_per_pair(with_features(joined(spark, folder)))
    return scoring.explain_prompt(
        forecasts,
        star_sales(spark, folder),
        "lag_units_7",
        {"lag": "lag_units_7", "roll": "roll_mean_7"},
        ("date", "units_sold"),
        SALES_TIES,
    )


_trained = {}


def training(spark, folder):
    """One trained forecaster per application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _trained:
        rows = rows_for_models(spark, folder)
        _trained[key] = train_forecaster(rows, HOLDOUT)
    return _trained[key]


def single_model(name):
    column = models.BASES[name]
    return lambda spark, folder: training(spark, folder).predictions().select(
        *KEYS, "true", column
    )


def hyperparam_search(spark, folder):
    """The adaptive search with the draws and folds of a training run, on the rows before the holdout."""
    table = f"{shared_folder(spark)}/trials-{uuid.uuid4().hex}"
    return search_boosted(rows_for_models(spark, folder), table, TRIALS, FOLDS, HOLDOUT)


_boosted = {}


def boosted(spark, folder):
    """One training of the histogram boosters per application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _boosted:
        _boosted[key] = train_boosted(rows_for_models(spark, folder), HOLDOUT)
    return _boosted[key]


def gain_importance(spark, folder):
    found = [
        boosting.gain_importance(model, spark).select(F.lit(family).alias("family"), "*")
        for family, model in boosted(spark, folder).models.items()
    ]
    return found[0].unionByName(found[1])


def contributions(spark, folder):
    latest = forecast_latest(feature_table(spark, folder).rows, training(spark, folder).forecaster)
    pairs = latest.withColumnsRenamed({"city": "city_name", "product": "product_id"})
    return scoring.contributions(pairs, models.BASES)


def batch_scores(spark, folder):
    rows = feature_table(spark, folder).rows
    scored = batch_score(rows, training(spark, folder).forecaster)
    return scored.select(*KEYS, "pred_gbt", "pred_rf", "pred_final")


QUERIES = {
    "scan_sales": scan_sales,
    "scan_inventory": star_inventory,
    "normalize_columns": normalize_columns,
    "parse_dates": parse_dates,
    "date_formats": date_formats,
    "infer_dates": infer_dates,
    "date_quarantine": date_quarantine,
    "outlier_filter": outlier_filter,
    "daily_sales": daily_sales,
    "inventory_stock": lambda s, d: aggregate.inventory_stock(star_inventory(s, d)),
    "join_inventory": lambda s, d: joined(s, d).select(*KEYS, "units_sold", "stock_quantity"),
    "impute_median": impute_median,
    "data_profile": data_profile,
    "dim_values": lambda s, d: aggregate.dim_values(star_sales(s, d)),
    "calendar_features": window_query(
        "day_of_week", "day_of_month", "month", "quarter", "week_of_year",
        "is_weekend", "is_month_start", "is_month_end", "season",
    ),
    "price_features": window_query("price_margin", "price_ratio", "discount_percent"),
    "lag_units": window_query(*[f"lag_units_{k}" for k in LAGS]),
    "lag_price": window_query(*[f"lag_price_{k}" for k in LAGS]),
    "rolling_units": window_query(
        *[f"roll_{s}_{k}" for k in ROLLING_WINDOWS for s in ("mean", "std", "max", "min")]
    ),
    "rolling_price": window_query(*[f"roll_price_mean_{k}" for k in ROLLING_WINDOWS]),
    "expanding_units": window_query("expanding_mean", "expanding_std", "expanding_count"),
    "trend_features": window_query("trend_ratio_7_28", "trend_diff_7_28"),
    "sale_frequency": window_query(
        "sold_flag", *[f"sale_frequency_{k}" for k in FREQUENCY_WINDOWS]
    ),
    "volatility": window_query("volatility_7"),
    "multi_horizon_targets": window_query(*[f"target_t{h}" for h in HORIZONS], "target"),
    "feature_blocks": feature_blocks,
    "expanding_shifted": expanding_shifted,
    "unseen_labels": unseen_labels,
    "min_history": lambda s, d: split.min_history(with_features(joined(s, d))).select(
        *KEYS, "units_sold"
    ),
    "encoder_vocab": lambda s, d: encode.fit_vocabulary(feature_table(s, d).rows),
    "label_encode": lambda s, d: feature_table(s, d).rows.select(
        *KEYS, *[f"{c}_enc" for c in ENCODED]
    ),
    "model_rows": lambda s, d: rows_for_models(s, d).select(*KEYS, "units_sold", "target"),
    "feature_matrix": feature_matrix,
    "feature_catalog": feature_catalog,
    "target_stats": target_stats,
    "holdout_split": lambda s, d: split.holdout_split(rows_for_models(s, d), HOLDOUT).select(
        *KEYS, "target", "split"
    ),
    "cv_folds": cv_folds,
    "cv_folds_by_date": lambda s, d: split.folds_by_date(rows_for_models(s, d)).select(
        *KEYS, "fold"
    ),
    "model_metrics": lambda s, d: rounded(
        evaluate.regression_metrics(naive(s, d), "target", NAIVE), CENT, *METRIC_NAMES
    ),
    "daily_error": lambda s, d: rounded(
        evaluate.daily_error(naive(s, d), "target", "pred_roll"), CENT, "mean_abs_error"
    ),
    "residual_histogram": lambda s, d: rounded(
        evaluate.residual_histogram(naive(s, d), "target", "pred_lag"), CENT, "bin_start", "bin_end"
    ),
    "weighted_ensemble": weighted_ensemble,
    "pair_history": pair_history,
    "recent_history": recent_history,
    "latest_per_pair": latest_per_pair,
    "align_features": align_features,
    "explain_prompt": explain_prompt,
    "train_gbt": single_model("gbt"),
    "train_rf": single_model("rf"),
    "stacking_meta": lambda s, d: training(s, d).meta_scores,
    "select_meta": lambda s, d: models.select_meta(training(s, d).meta_scores),
    "trained_metrics": lambda s, d: training(s, d).metrics(),
    "prediction_summary": lambda s, d: training(s, d).predictions(),
    "prediction_pairs": lambda s, d: evaluate.prediction_pairs(
        training(s, d).predictions(), "true", "pred_meta"
    ),
    "feature_importance": lambda s, d: models.feature_importance(
        training(s, d).forecaster.gbt, s
    ),
    "top_features": lambda s, d: models.top_features(
        models.feature_importance(training(s, d).forecaster.gbt, s), 25
    ),
    "hyperparam_search": hyperparam_search,
    "boosting_curve": lambda s, d: boosted(s, d).curve(s),
    "boosted_predictions": lambda s, d: boosted(s, d).scored,
    "boosted_metrics": lambda s, d: boosted(s, d).metrics(),
    "boosted_trees": lambda s, d: boosted(s, d).nodes(s),
    "gain_importance": gain_importance,
    "target_dates": window_query(*[f"target_date_t{h}" for h in HORIZONS]),
    "batch_score": batch_scores,
    "forecast_latest": lambda s, d: forecast_latest(
        feature_table(s, d).rows, training(s, d).forecaster
    ),
    "contributions": contributions,
}
