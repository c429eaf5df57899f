import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from demandcast.operators.aggregate import daily_sales
from demandcast.operators.series import BLOCK_ROWS, series_features, zero_fill
from demandcast.plans.features import with_features, with_row_features
from demandcast.schema import FREQUENCY_WINDOWS, HORIZONS, LAGS, ROLLING_WINDOWS
from demandcast.session import materialize
from tests.conftest import days, values


def features(raw, block_rows=BLOCK_ROWS):
    return with_features(daily_sales(raw), block_rows)


def test_lags_count_rows_not_days(sales):
    raw = sales(("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-09", 9), ("2024-01-30", 30))
    rows = features(raw).orderBy("date").collect()
    assert [r.lag_units_1 for r in rows] == [0, 1, 2, 9]
    assert [r.lag_units_3 for r in rows] == [0, 0, 0, 1]
    assert [r.target_t1 for r in rows] == [2, 9, 30, None]
    assert [r.expanding_count for r in rows] == [1, 2, 3, 4]
    assert [r.roll_mean_3 for r in rows] == [0, 1, 1.5, 4]
    assert [r.roll_max_3 for r in rows] == [0, 1, 2, 9]


def test_volatility(sales):
    raw = sales(*zip(days(5), [1, 3, 2, 8, 5]))
    got = [r.volatility_7 for r in features(raw).orderBy("date").collect()]
    assert got == pytest.approx([0, 0, 0.499999750000125, 0.4082480863398198, 0.7693090383594895])


def test_fill_order(sales):
    first = features(sales(("2024-01-01", 5))).first()
    assert first.trend_ratio_7_28 == 1 and first.trend_diff_7_28 == 0
    assert first.roll_std_7 == 0 and first.mrp_std == 0
    assert first.target is None and first.target_t30 is None


def test_calendar(sales):
    raw = sales(
        ("2020-12-31", 1), ("2021-01-03", 1), ("2021-01-04", 1), ("2021-03-07", 1),
        ("2021-08-24", 1), ("2021-11-08", 1),
    )
    out = features(raw).orderBy("date")
    assert values(out, "week_of_year", "day_of_week", "is_weekend") == [
        (53, 3, 0), (53, 6, 1), (1, 0, 0), (9, 6, 1), (34, 1, 0), (45, 0, 0),
    ]
    assert values(out, "season", "quarter", "is_month_start", "is_month_end") == [
        ("winter", 4, 0, 1), ("winter", 1, 1, 0), ("winter", 1, 1, 0), ("spring", 1, 1, 0),
        ("summer", 3, 0, 1), ("autumn", 4, 0, 0),
    ]


def test_price_clipping(sales):
    raw = sales(
        ("2024-01-01", 1, {"mrp": 0.0, "selling_price": 5.0}),
        ("2024-01-02", 1, {"mrp": 4.0, "selling_price": 5.0}),
        ("2024-01-03", 1, {"mrp": None, "selling_price": None}),
    )
    out = with_row_features(daily_sales(raw)).orderBy("date")
    got = values(out, "price_margin", "price_ratio", "discount_percent")
    assert got[0] == (-5.0, 10.0, 0.0)
    assert got[1] == (-1.0, pytest.approx(1.25, rel=1e-6), 0.0)
    assert got[2] == (0.0, None, None)


def test_ties_follow_labels(sales):
    raw = sales(*[("2024-01-01", u, {"product_name": n}) for n, u in (("b", 2), ("a", 1), ("c", 3))])
    out = features(raw).orderBy("product_name")
    assert values(out, "product_name", "lag_units_1") == [("a", 0), ("b", 1), ("c", 2)]


def expected(units, price):
    """The same columns from pandas, for one series in order."""
    u, p = pd.Series(units, dtype=float), pd.Series(price, dtype=float)
    past, past_price, sold = u.shift(1), p.shift(1), (u > 0).astype(int).shift(1)
    out = {}
    for k in LAGS:
        out[f"lag_units_{k}"], out[f"lag_price_{k}"] = u.shift(k), p.shift(k)
    for k in ROLLING_WINDOWS:
        roll = past.rolling(k, min_periods=1)
        for name in ("mean", "std", "max", "min"):
            out[f"roll_{name}_{k}"] = getattr(roll, name)()
        out[f"roll_price_mean_{k}"] = past_price.rolling(k, min_periods=1).mean()
    for k in FREQUENCY_WINDOWS:
        out[f"sale_frequency_{k}"] = sold.rolling(k, min_periods=1).mean()
    out["expanding_mean"] = past.expanding(min_periods=1).mean()
    out["expanding_std"] = past.expanding(min_periods=1).std()
    week = past.rolling(7, min_periods=2)
    out["volatility_7"] = week.std(ddof=0) / (week.mean() + 1e-6)
    mean7, mean28 = out["roll_mean_7"], out["roll_mean_28"]
    out["trend_ratio_7_28"] = (mean7 / (mean28 + 1e-6)).fillna(1)
    out["trend_diff_7_28"] = (mean7 - mean28).fillna(0)
    frame = pd.DataFrame(out).fillna(0)
    frame["expanding_count"] = np.arange(1, len(u) + 1)
    for h in HORIZONS:
        frame[f"target_t{h}"] = u.shift(-h)
    return frame


@pytest.mark.parametrize("block_rows", [BLOCK_ROWS, 40])
def test_against_pandas(sales, block_rows):
    source = np.random.default_rng(5)
    rows, want = [], {}
    for city, n in (("x", 1), ("y", 36), ("z", 170)):
        units, price = source.integers(0, 9, n), source.uniform(1, 9, n).round(2)
        want[city] = expected(units, price)
        rows += [
            (d, u, {"city_name": city, "selling_price": float(p)})
            for d, u, p in zip(days(n), units, price)
        ]
    got = features(sales(*rows), block_rows).toPandas().sort_values("date")
    for city, frame in want.items():
        part = got[got.city_name == city].reset_index(drop=True)
        assert (part.series_rows == len(frame)).all()
        for name in frame.columns:
            np.testing.assert_allclose(
                part[name].astype(float), frame[name], rtol=1e-9, atol=1e-7, err_msg=name
            )


@pytest.mark.parametrize("block_rows", [BLOCK_ROWS, 64])
def test_large_values_do_not_cancel(sales, block_rows):
    """Small spreads at a level of a thousand million, across block borders."""
    units = [1e9 + i % 3 for i in range(200)]
    got = features(sales(*zip(days(200), units)), block_rows).toPandas().sort_values("date")
    past = pd.Series(units).shift(1).expanding()
    np.testing.assert_allclose(got["expanding_mean"], past.mean().fillna(0), rtol=1e-9)
    np.testing.assert_allclose(got["expanding_std"], (past.apply(np.std, kwargs={"ddof": 1})).fillna(0), rtol=1e-9)


def test_block_length_changes_nothing(sales):
    """Rows of a long and a short series are the same for any length of a block."""
    rows = [(d, i % 7) for i, d in enumerate(days(150))]
    rows += [(d, 2, {"city_name": "y"}) for d in days(9)]
    daily = materialize(daily_sales(sales(*rows)), "test")
    plain = {(r.city_name, r.date): r for r in with_features(daily).collect()}
    cut = with_features(daily, 40).select(*next(iter(plain.values())).__fields__)
    got = {(r.city_name, r.date): r for r in cut.collect()}
    assert got.keys() == plain.keys()
    for key, row in got.items():
        for name, a, b in zip(row.__fields__, row, plain[key]):
            if isinstance(a, float):
                assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), name
            else:
                assert a == b, name


def test_no_series_lies_in_one_task(sales):
    """Rows move by series and date, then by series and block; one exchange serves all windows of a block."""
    daily = materialize(daily_sales(sales(*zip(days(40), range(40)))), "test")
    plan = zero_fill(series_features(daily))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    by_block = [line for line in moved if "_block" in line]
    assert 1 <= len(by_block) <= 2  # the rows, and the block totals unless they are broadcast


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 50), min_size=2, max_size=45), st.data())
def test_past_features_ignore_the_future(sales, units, data):
    cut = data.draw(st.integers(1, len(units) - 1))
    names = [f"roll_mean_{k}" for k in ROLLING_WINDOWS] + ["expanding_std", "lag_units_2", "volatility_7"]
    whole = values(features(sales(*zip(days(len(units)), units))).orderBy("date"), *names)
    part = features(sales(*zip(days(cut), units[:cut]))).orderBy("date")
    assert values(part, *names) == whole[:cut]
    bounds = features(sales(*zip(days(len(units)), units))).where(
        "roll_min_7 > roll_mean_7 or roll_mean_7 > roll_max_7"
    )
    assert bounds.count() == 0
