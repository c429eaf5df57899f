import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandcast.operators import models
from demandcast.operators.split import folds_by_date, model_rows
from demandcast.plans.features import build_features
from demandcast.plans.jobs import UnknownPair, run_forecast, run_scoring, run_training, search_params
from demandcast.plans.score import batch_score, forecast_latest
from demandcast.plans.train import Forecaster, NoForecast, assign_roles, train_forecaster
from demandcast.schema import FEATURES, INVENTORY, METRICS
from demandcast.sources import artifacts
from demandcast.sources.tables import read_inventory, read_sales
from demandcast.session import materialize
from demandcast.streaming.score import score_uploads, write_scores
from tests.conftest import days

SMALL_GBT, SMALL_RF = {"maxIter": 5, "maxDepth": 3}, {"numTrees": 5, "maxDepth": 4}


@pytest.fixture(scope="module")
def table(spark):
    """Four series with a weekly pattern and little noise."""
    source = np.random.default_rng(11)
    rows = []
    for p, level in (("p1", 5), ("p2", 20)):
        for city in "xy":
            for i, d in enumerate(days(140)):
                units = level + 3 * (i % 7) + int(source.integers(0, 2))
                rows.append((d, p, "n" + p, "c", "s", city, float(units), 8.0, 10.0))
    names = "date string, product_id string, product_name string, category string, sub_category string, city_name string, units_sold double, selling_price double, mrp double"
    sales = spark.createDataFrame(rows, names).withColumn("date", F.to_date("date"))
    stock = spark.createDataFrame([("p1", "x", 3.0)], INVENTORY)
    return build_features(sales, stock)


@pytest.fixture(scope="module", params=[False, True], ids=["default", "reference"])
def training(request, table):
    return train_forecaster(model_rows(table.rows), 14, SMALL_GBT, SMALL_RF, request.param)


def test_roles(table):
    rows = model_rows(table.rows)
    counts = {r.role: r["count"] for r in assign_roles(rows).groupBy("role").count().collect()}
    assert counts["test"] == counts["valid"] == 14 * 4
    flat = {r.role: r["count"] for r in assign_roles(rows, 14, True).groupBy("role").count().collect()}
    assert set(flat) == {"fit", "test"} and flat["test"] == counts["test"]
    with pytest.raises(ValueError, match="holdout_days"):
        train_forecaster(rows, 1000)


def test_training(training):
    predictions = training.predictions()
    assert predictions.count() == 14 * 4
    assert predictions.columns[3:-5] == list(FEATURES)
    got = {r.model: r for r in training.metrics().collect()}
    assert set(got) == {"GBT", "RF", "Ensemble", "MetaLearner"}
    spread = predictions.agg(F.avg(F.abs(F.col("true") - 17.0))).first()[0]
    for row in got.values():
        assert all(math.isfinite(row[m]) for m in METRICS)
        assert row.rmse >= row.mae and row.median_ae <= row.q90_ae
        assert row.mae < spread
    assert got["Ensemble"].mae <= max(got["GBT"].mae, got["RF"].mae) + 1e-9
    assert sum(training.forecaster.weights.values()) == pytest.approx(1)
    scores = training.meta_scores.orderBy("ordinal").collect()
    assert [r.name for r in scores] == ["Ridge", "Lasso", "ElasticNet"]
    assert training.meta_name == min(scores, key=lambda r: (r.mae, r.ordinal)).name


def test_stack_never_sees_the_rows_it_is_chosen_on(table):
    """Stack rows lie before all rows of the choice; served models are refits on everything before the test."""
    rows = model_rows(table.rows)
    got = train_forecaster(rows, 14, SMALL_GBT, SMALL_RF, stack_folds=2)
    last = got.stacked.agg(F.max("date")).first()[0]
    first = got.judged.agg(F.min("date")).first()[0]
    assert last < first and got.judged.count() == 14 * 4
    marked = assign_roles(rows, 14)
    known = models.assemble(marked.where("role <> 'test'")).select("target", "features")
    again = models.fit_rf(known, SMALL_RF)
    sample = models.assemble(marked.where("role = 'test'").limit(20)).select("features")
    ours, theirs = got.forecaster.rf.transform(sample), again.transform(sample)
    assert [r.pred_rf for r in ours.collect()] == pytest.approx([r.pred_rf for r in theirs.collect()])
    assert got.scored.select("role").distinct().collect()[0][0] == "test"


def test_scoring_and_storage(spark, table, training, tmp_path):
    folder = str(tmp_path / "run")
    artifacts.write_reports(training, table.vocabulary, folder)
    loaded = artifacts.load_forecaster(spark, folder)
    assert loaded.features == FEATURES
    keys = ["date", "product_id", "city_name"]
    ours = batch_score(table.rows, training.forecaster)
    assert ours.columns == table.rows.columns + ["pred_gbt", "pred_rf", "pred_final"]
    both = ours.select(*keys, "pred_final").join(
        batch_score(table.rows, loaded).select(*keys, F.col("pred_final").alias("other")), keys
    )
    assert both.where("abs(pred_final - other) < 1e-9").count() == table.rows.count()
    latest = forecast_latest(table.rows, loaded)
    assert latest.count() == 4 and latest.columns[:3] == ["city", "product", "predicted_units_next_7d"]
    vocabulary = artifacts.load_vocabulary(spark, f"{folder}/vocabulary")
    assert vocabulary.count() == table.vocabulary.count()
    assert len(spark.read.csv(f"{folder}/feature_importance", header=True).collect()) == len(FEATURES)
    assert spark.read.json(f"{folder}/metrics_summary").count() == 4
    path = artifacts.write_forecasts(latest, folder, "forecast")
    assert spark.read.csv(path, header=True).count() == 4


def test_missing_models(spark, table, training, tmp_path):
    full = training.forecaster
    assert artifacts.load_model(artifacts.KINDS["gbt"], str(tmp_path / "none")) is None
    mean = batch_score(table.rows, Forecaster(full.gbt, full.rf))
    assert mean.where("abs(pred_final - (pred_gbt + pred_rf) / 2) > 1e-9").count() == 0
    alone = batch_score(table.rows, Forecaster(gbt=full.gbt))
    assert alone.where("pred_final <> pred_gbt").count() == 0 and "pred_rf" not in alone.columns
    for broken in (Forecaster(), Forecaster(gbt=full.gbt, meta=full.meta)):
        with pytest.raises(NoForecast):
            batch_score(table.rows, broken)


def test_stream(spark, table, training, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = table.rows.select("product_id", "city_name", *FEATURES)
    rows.write.csv(source, header=True)
    scored = score_uploads(spark, source, rows.schema, training.forecaster)
    write_scores(scored, out, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.csv(out, header=True, inferSchema=True)
    assert got.count() == rows.count()
    want = batch_score(table.rows, training.forecaster).agg(F.sum("pred_final")).first()[0]
    assert got.agg(F.sum("pred_final")).first()[0] == pytest.approx(want)


def test_penalties(spark):
    """The three candidates against coordinate descent on the textbook objectives."""
    source = np.random.default_rng(2)
    x = source.normal(0, 3, (200, 2)) + [5, 7]
    y = 2 * x[:, 0] - 1.5 * x[:, 1] + source.normal(0, 1, 200)
    rows = [(float(t), float(a), float(b)) for t, (a, b) in zip(y, x)]
    df = spark.createDataFrame(rows, "target double, pred_gbt double, pred_rf double")
    got = models.fit_meta_candidates(df)
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    for name, (alpha, ratio) in models.META_PENALTIES.items():
        first, second = (0, alpha / n) if name == "Ridge" else (alpha * ratio, alpha * (1 - ratio))
        w = np.zeros(2)
        for _ in range(5000):
            for j in range(2):
                rest = yc - xc @ w + xc[:, j] * w[j]
                pull = xc[:, j] @ rest / n
                w[j] = np.sign(pull) * max(abs(pull) - first, 0) / (xc[:, j] @ xc[:, j] / n + second)
        assert list(got[name].coefficients) == pytest.approx(list(w), rel=1e-4)


def test_search(table):
    rows = materialize(folds_by_date(model_rows(table.rows), 2), "test")
    out = models.hyperparam_search(rows, "gbt", 2, {"maxDepth": ("int", 2, 3), "stepSize": ("log", 0.05, 0.3)}, {"maxIter": 3})
    got = out.collect()
    assert {(r.trial, r.fold) for r in got} == {(t, f) for t in (0, 1) for f in (1, 2)}
    assert all(r.mae > 0 for r in got)
    best = models.best_trial(out).first()
    assert best.mae == pytest.approx(min(np.mean([r.mae for r in got if r.trial == t]) for t in (0, 1)))


def test_draws_stay_in_range():
    for space in (models.GBT_SPACE, models.RF_SPACE):
        for params in models.draw(space, 50):
            for name, (_, low, high) in space.items():
                assert low <= float(params[name]) <= high
    assert models.draw(models.GBT_SPACE, 3) == models.draw(models.GBT_SPACE, 3)


def test_jobs_from_csv(spark, table, tmp_path):
    """Train from files, then forecast and score with what was written."""
    sales = table.rows.select(
        "date", "product_id", "product_name", "category", "sub_category", "city_name",
        "units_sold", "selling_price", "mrp",
    )
    sales.write.csv(str(tmp_path / "sales"), header=True)
    (tmp_path / "inventory.csv").write_text("Product_ID,City Name,Stock Quantity\np1,x,3\n")
    raw = read_sales(spark, str(tmp_path / "sales"))
    stock = read_inventory(spark, str(tmp_path / "inventory.csv"))
    folder = str(tmp_path / "run")
    small = {"gbt": {"maxIter": 2, "maxDepth": 2}, "rf": {"numTrees": 2, "maxDepth": 3}}
    again, training = run_training(raw, stock, folder, params=small, trials=1, folds=2)
    assert spark.read.csv(f"{folder}/search_results", header=True).count() == 4
    assert again.rows.count() == table.rows.count()
    reports = {
        name: spark.read.csv(f"{folder}/{name}", header=True).count()
        for name in ("daily_error", "residual_histogram", "prediction_pairs", "data_profile", "target_stats")
    }
    assert reports["daily_error"] == 14 and reports["prediction_pairs"] == 14 * 4
    assert reports["data_profile"] == 3 and reports["target_stats"] == 1 and reports["residual_histogram"] > 1
    forecasts = run_forecast(spark, raw, stock, folder)
    want = forecast_latest(table.rows, training.forecaster)
    both = forecasts.withColumnRenamed("predicted_units_next_7d", "a").join(
        want.withColumnRenamed("predicted_units_next_7d", "b"), ["city", "product"]
    )
    assert both.where("abs(a - b) < 1e-9").count() == 4
    first = forecasts.orderBy("city", "product").first()
    alone = run_forecast(spark, raw, stock, folder, (first["city"], first["product"])).collect()
    assert len(alone) == 1
    assert alone[0]["predicted_units_next_7d"] == pytest.approx(first["predicted_units_next_7d"], rel=1e-9)
    with pytest.raises(UnknownPair):
        run_forecast(spark, raw, stock, folder, ("nowhere", "p1"))
    assert run_scoring(spark, raw, folder).where("pred_final is not null").count() == raw.count()


@pytest.mark.parametrize("reference_mode", [False, True])
def test_search_feeds_training(table, reference_mode):
    spaces = {"gbt": {"maxDepth": ("int", 2, 3)}, "rf": {"maxDepth": ("int", 2, 4)}}
    fixed = {"gbt": {"maxIter": 2}, "rf": {"numTrees": 2}}
    best = search_params(model_rows(table.rows), 2, 2, 14, reference_mode, spaces, fixed)
    assert best["gbt"]["maxIter"] == 2 and best["gbt"]["maxDepth"] in (2, 3)
    assert best["rf"]["numTrees"] == 2 and best["rf"]["maxDepth"] in (2, 3, 4)


def test_trained_queries_run_the_whole_job(spark, monkeypatch):
    from inspect import signature

    from checks import spark_queries as queries
    from demandcast.plans.jobs import run_training

    calls = {}
    table = spark.createDataFrame([(0, 1, "", 1.0, "gbt")], "trial int, fold int, params string, mae double, family string")

    def train(rows, holdout_days, gbt_params=None, rf_params=None, **other):
        calls["train"] = (gbt_params, rf_params, other)

    def search(rows, stored, trials, folds, holdout_days, **other):
        calls["search"] = (trials, folds, other)
        return table

    monkeypatch.setattr(queries, "rows_for_models", lambda spark, folder: table)
    monkeypatch.setattr(queries, "train_forecaster", train)
    monkeypatch.setattr(queries, "search_boosted", search)
    monkeypatch.setattr(queries, "_trained", {})
    queries.training(spark, "folder")
    assert calls["train"] == (None, None, {})
    assert queries.hyperparam_search(spark, "folder") is table
    default = signature(run_training).parameters
    assert calls["search"] == (default["trials"].default, default["folds"].default, {})
