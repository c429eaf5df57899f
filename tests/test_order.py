import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from demandcast.operators.encode import UNSEEN, fit_vocabulary, label_encode
from demandcast.operators.ordering import preceding_total
from demandcast.operators.quantiles import exact_quantiles
from demandcast.operators.split import (
    folds_by_date,
    folds_by_position,
    holdout_split,
    min_history,
    model_rows,
)
from demandcast.plans.features import with_features
from demandcast.operators.aggregate import daily_sales
from tests.conftest import days, values


@pytest.mark.parametrize("pieces", [2, 16, 256])
def test_preceding_total(spark, pieces):
    df = spark.range(500).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), (F.col("id") % 5).alias("n")
    )
    got = {r.k: r.t for r in preceding_total(df, ["k"], "n", "t", pieces).collect()}
    total = 0
    for key, n in sorted((f"k{i}", i % 5) for i in range(500)):
        assert got[key] == total
        total += n


@pytest.mark.parametrize("pieces", [2, 40, 256])
def test_grouped_quantiles(spark, pieces):
    source = np.random.default_rng(1)
    groups = {"hot": source.lognormal(3, 2, 3000), "ties": np.repeat([1.0, 2.0], 50), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = {"a": 0.0, "b": 0.123, "c": 0.5, "d": 0.999, "e": 1.0}
    out = exact_quantiles(df, "v", probabilities, by=("g",), pieces=pieces)
    for row in out.collect():
        want = np.quantile(groups[row.g], list(probabilities.values()))
        assert list(row[1:]) == pytest.approx(list(want), rel=1e-12)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.floats(-1e6, 1e6, width=32) | st.just(float("nan")) | st.none(), min_size=1, max_size=60),
    st.floats(0, 1),
)
def test_quantile_of_anything(spark, numbers, p):
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    got = exact_quantiles(df, "v", {"q": p}, pieces=4).collect()
    known = [v for v in numbers if v is not None and v == v]
    if known:
        assert got[0].q == pytest.approx(float(np.quantile(known, p)), rel=1e-9, abs=1e-9)
    else:
        assert got[0].q is None


def test_codes_are_ranks_of_text(spark):
    df = spark.createDataFrame([(v, "z") for v in ("10", "2", "a", "B", "2", None)], "p string, q string")
    vocabulary = fit_vocabulary(df, ("p", "q"))
    got = {(r.column, r.value): r.code for r in vocabulary.collect()}
    assert got == {("p", "10"): 0, ("p", "2"): 1, ("p", "B"): 2, ("p", "a"): 3, ("q", "z"): 0}
    unseen = spark.createDataFrame([("2", "z"), ("new", "z")], "p string, q string")
    assert sorted(values(label_encode(unseen, vocabulary, ("p", "q")), "p", "p_enc", "q_enc")) == [
        ("2", 1, 0), ("new", UNSEEN, 0),
    ]


@pytest.fixture
def panel(sales):
    rows = [(d, 1, {"city_name": c}) for c, n in (("a", 35), ("b", 36), ("c", 1), ("d", 60)) for d in days(n)]
    return with_features(daily_sales(sales(*rows)))


def test_history_and_rows(panel):
    want = {"b": 36, "d": 60}
    for df in (panel, panel.drop("series_rows")):
        assert {r.city_name: r["count"] for r in min_history(df).groupBy("city_name").count().collect()} == want
    rows = model_rows(panel)
    assert rows.groupBy("city_name").count().where("city_name = 'd'").first()["count"] == 53


def test_split(panel):
    rows = holdout_split(model_rows(panel), 14)
    last = rows.agg(F.max("date")).first()[0]
    assert {(last - r.date).days < 14 for r in rows.where("split = 'test'").collect()} == {True}
    assert rows.where("split = 'test'").count() == 14


def test_folds_by_position(panel):
    rows = folds_by_position(model_rows(panel), 5).orderBy("product_id", "city_name", "date").collect()
    n = len(rows)
    assert [r.position for r in rows] == list(range(n))
    size, want = n // 6, []
    for i in range(n):
        want.append(next((k for k in range(1, 6) if n - (6 - k) * size <= i < n - (5 - k) * size), 0))
    assert [r.fold for r in rows] == want


def test_folds_by_date_never_look_ahead(panel):
    rows = folds_by_date(model_rows(panel), 3)
    ends = {r.fold: (r.a, r.b) for r in rows.groupBy("fold").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    assert sorted(ends) == [0, 1, 2, 3]
    assert all(ends[k][1] < ends[k + 1][0] for k in range(3))
