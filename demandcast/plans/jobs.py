"""The three user-facing jobs: train, forecast every pair, score a table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandcast.operators.aggregate import table_profile, target_stats
from demandcast.operators.models import drawn_params, hyperparam_search
from demandcast.operators.split import folds_by_date, folds_by_position, model_rows
from demandcast.plans.features import FeatureTable, build_features
from demandcast.plans.score import batch_score, forecast_latest
from demandcast.plans.train import Training, assign_roles, train_forecaster
from demandcast.schema import HOLDOUT_DAYS
from demandcast.session import scratch
from demandcast.sources import artifacts

#: Parameter sets that training draws for each base model, and the folds each is tried on.
TRIALS, FOLDS = 10, 5


def search_params(
    rows: DataFrame,
    trials: int,
    folds: int,
    holdout_days: int = HOLDOUT_DAYS,
    reference_mode: bool = False,
    spaces: dict | None = None,
    fixed: dict | None = None,
) -> dict:
    """Best drawn parameters of both base models, by family."""
    return search(rows, trials, folds, holdout_days, reference_mode, spaces, fixed)[0]


def search(
    rows: DataFrame,
    trials: int,
    folds: int,
    holdout_days: int = HOLDOUT_DAYS,
    reference_mode: bool = False,
    spaces: dict | None = None,
    fixed: dict | None = None,
) -> tuple[dict, DataFrame]:
    """Best drawn parameters by family, and (family, trial, fold, params, mae) of all fits.

    Folds are cut by date within the rows before the holdout. In reference
    mode they are cut by position over all rows, in product, city, date order.
    """
    if reference_mode:
        folded = folds_by_position(rows, folds)
    else:
        marked = assign_roles(rows, holdout_days)
        folded = folds_by_date(marked.where("role <> 'test'").drop("role"), folds)
    best, tried = {}, None
    with scratch(rows.sparkSession) as store:
        folded = store(folded, "folds")
        for family in ("gbt", "rf"):
            space, extra = (spaces or {}).get(family), (fixed or {}).get(family)
            results = hyperparam_search(folded, family, trials, space, extra)
            best[family] = drawn_params(results, family, trials, space, extra)
            results = results.select(F.lit(family).alias("family"), "*")
            tried = results if tried is None else tried.unionByName(results)
    return best, tried


def run_training(
    sales: DataFrame,
    inventory: DataFrame,
    folder: str,
    holdout_days: int = HOLDOUT_DAYS,
    params: dict | None = None,
    trials: int = TRIALS,
    folds: int = FOLDS,
    reference_mode: bool = False,
) -> tuple[FeatureTable, Training]:
    """Features, search, training, and all results written to `folder`.

    `trials` parameter sets are drawn per base model and tried on `folds` folds;
    0 takes `params` and the defaults as they are.
    """
    table = build_features(sales, inventory)
    rows = model_rows(table.rows)
    params = params or {}
    if trials:
        params, tried = search(rows, trials, folds, holdout_days, reference_mode, fixed=params)
        artifacts.write_csv(tried, f"{folder}/search_results")
    training = train_forecaster(
        rows, holdout_days, params.get("gbt"), params.get("rf"), reference_mode
    )
    artifacts.write_reports(training, table.vocabulary, folder)
    profile = table_profile({"sales": sales, "inventory": inventory, "features": table.rows})
    artifacts.write_csv(profile, f"{folder}/data_profile")
    artifacts.write_csv(target_stats(rows), f"{folder}/target_stats")
    return table, training


class UnknownPair(ValueError):
    """No rows of the asked city and product."""


def run_forecast(
    spark: SparkSession,
    sales: DataFrame,
    inventory: DataFrame,
    folder: str,
    pair: tuple[str, str] | None = None,
) -> DataFrame:
    """Forecast of every pair, or of one (city, product) `pair`, from raw tables,
    with the models and codes in `folder`."""
    vocabulary = artifacts.load_vocabulary(spark, f"{folder}/vocabulary")
    table = build_features(sales, inventory, vocabulary, pair)
    if pair and table.rows.isEmpty():
        raise UnknownPair(f"no sales of product {pair[1]!r} in {pair[0]!r}")
    return forecast_latest(table.rows, artifacts.load_forecaster(spark, folder))


def run_scoring(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Any table of feature columns, scored with the models in `folder`."""
    return batch_score(rows, artifacts.load_forecaster(spark, folder))
