import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandcast.operators import evaluate
from demandcast.operators.history import latest_per_pair, pair_history, recent_history
from demandcast.operators.scoring import align_features, contributions, explain_prompt
from demandcast.schema import FEATURES
from tests.conftest import days, values

MODELS = {"m": "p"}


def pairs(spark, y, p):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")


def metrics(spark, y, p):
    return evaluate.regression_metrics(pairs(spark, y, p), "y", MODELS).first()


def test_metrics(spark):
    source = np.random.default_rng(3)
    y, p = source.integers(0, 6, 101).astype(float), source.uniform(0, 6, 101)
    got, error = metrics(spark, y, p), np.abs(y - p)
    assert got.mae == pytest.approx(error.mean())
    assert got.rmse == pytest.approx(math.sqrt((error**2).mean()))
    assert got.mape_pct == pytest.approx((error[y != 0] / y[y != 0]).mean() * 100)
    assert got.r2 == pytest.approx(1 - (error**2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.median_ae == pytest.approx(np.median(error))
    assert got.q90_ae == pytest.approx(np.percentile(error, 90))


def test_metrics_of_odd_sets(spark):
    assert metrics(spark, [0, 0], [1, 1]).mape_pct == math.inf
    assert metrics(spark, [2, 2], [2, 2]).r2 == 1
    assert metrics(spark, [2, 2], [1, 2]).r2 == 0
    assert metrics(spark, [3], [1]).r2 == 0


def test_histogram(spark):
    def counts(y, p, bins):
        rows = evaluate.residual_histogram(pairs(spark, y, p), "y", "p", bins).orderBy("bin").collect()
        return [r["count"] for r in rows], rows[0].bin_start, rows[-1].bin_end

    assert counts([0, 1, 2, 3, 4], [0] * 5, 4) == ([1, 1, 1, 2], 0, 4)
    want, edges = np.histogram([2.0, 2.0, 2.0], 5)
    assert counts([2, 2, 2], [0] * 3, 5) == (list(want), edges[0], edges[-1])


def test_blend(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (3.0, 4.0, 6.0)], "y double, a double, b double")
    models = {"a": "a", "b": "b"}
    got = {r.model: r.weight for r in evaluate.blend_weights(df, "y", models).collect()}
    assert got == {"a": pytest.approx(0.75), "b": pytest.approx(0.25)}
    out = evaluate.weighted_ensemble(df, "y", models)
    assert [r.pred_ensemble for r in out.collect()] == pytest.approx([2.5, 4.5])
    exact = spark.createDataFrame([(1.0, 1.0, 3.0)], "y double, a double, b double")
    weights = {r.model: r.weight for r in evaluate.blend_weights(exact, "y", models).collect()}
    assert weights["a"] == pytest.approx(1 / 1.5)  # an MAE of 0 counts as weight 1


def test_daily_error(spark):
    df = spark.createDataFrame([("d", 1.0, 2.0), ("d", 1.0, 4.0)], "date string, y double, p double")
    assert evaluate.daily_error(df, "y", "p").first().mean_abs_error == 2


def test_history(sales):
    raw = sales(*[(d, i, {"city_name": c}) for c in "xy" for i, d in enumerate(days(12))])
    recent = recent_history(raw)
    assert recent.groupBy("city_name").count().where("count = 10").count() == 2
    assert {r.units_sold for r in latest_per_pair(raw).collect()} == {11.0}
    assert pair_history(raw, "x", "p1").count() == 12
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_align(spark):
    df = spark.createDataFrame([("1.5", "x", None, 9)], "mrp string, month string, quarter double, extra int")
    out = align_features(df)
    assert tuple(out.columns) == FEATURES
    row = out.first()
    assert (row.mrp, row.month, row.quarter, row.lag_units_1) == (1.5, 0.0, 0.0, 0.0)


def test_prompt_and_contributions(spark, sales):
    raw = sales(*[(d, i) for i, d in enumerate(days(10))])
    forecast = spark.createDataFrame([("p1", "x", 4.5, 1.234)], "product_id string, city_name string, f double, a double")
    text = explain_prompt(forecast, raw, "f", {"a": "a"}, ("date", "units_sold")).first().prompt
    assert "- City: x\n- Product: p1\n- Predicted units (next 7 days): 4.5\n" in text
    assert "- Model contributions:\n- a: 1.23\n" in text
    assert "date,units_sold\n2024-01-03,2.0\n" in text and "2024-01-10,9.0\n" in text
    only_dates = explain_prompt(forecast, raw, "f", {"a": "a"}).first().prompt
    assert "(last rows):\ndate\n2024-01-03\n" in only_dates
    assert values(contributions(forecast, {"a": "a"}), "model", "value") == [("a", "1.23")]


def test_text_that_only_looks_like_a_number_is_zero(spark):
    df = spark.createDataFrame(
        [("1d",), ("1f",), (" 2.5 ",), ("-1e3",), (".5",), ("",), (None,), ("x1",)], "mrp string"
    ).withColumns({"selling_price": F.lit("2024-01-01").cast("date"), "is_weekend": F.lit(True)})
    rows = align_features(df, ("mrp", "selling_price", "is_weekend")).collect()
    assert [r.mrp for r in rows] == [0, 0, 2.5, -1000, 0.5, 0, 0, 0]
    assert {(r.selling_price, r.is_weekend) for r in rows} == {(0.0, 1.0)}


# The published names and order of the model inputs.
GOLDEN = """
product_id_enc city_name_enc category_enc sub_category_enc season_enc day_of_week day_of_month month quarter week_of_year
is_weekend is_month_start is_month_end selling_price mrp price_margin price_ratio discount_percent price_volatility
transaction_count stock_quantity expanding_mean expanding_std expanding_count trend_ratio_7_28 trend_diff_7_28 volatility_7
lag_units_1 lag_units_2 lag_units_3 lag_units_7 lag_units_14 lag_units_21 lag_units_28 lag_units_35
lag_price_1 lag_price_2 lag_price_3 lag_price_7 lag_price_14 lag_price_21 lag_price_28 lag_price_35
roll_mean_3 roll_std_3 roll_max_3 roll_min_3 roll_price_mean_3 roll_mean_7 roll_std_7 roll_max_7 roll_min_7 roll_price_mean_7
roll_mean_14 roll_std_14 roll_max_14 roll_min_14 roll_price_mean_14
roll_mean_28 roll_std_28 roll_max_28 roll_min_28 roll_price_mean_28
sale_frequency_7 sale_frequency_14 sale_frequency_28
""".split()


def test_model_inputs_are_the_published_ones():
    assert list(FEATURES) == GOLDEN and len(GOLDEN) == 66
