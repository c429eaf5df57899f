import pathlib

import pytest
from pyspark.sql import functions as F

from demandcast.operators.aggregate import (
    daily_sales,
    dim_values,
    inventory_stock,
    join_inventory,
    table_profile,
)
from demandcast.operators.clean import drop_outliers, normalize_columns, parse_dates
from demandcast.operators.impute import impute_median
from demandcast.plans.features import fill_prices
from demandcast.schema import INVENTORY
from demandcast.session import materialize, scratch, shared_folder
from demandcast.sources.tables import read_inventory, read_sales
from tests.conftest import values


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], [" Units Sold ", "City Name"])
    assert normalize_columns(df).columns == ["units_sold", "city_name"]


@pytest.mark.parametrize(
    "date_format,kept", [("yyyy-MM-dd", ["2024-01-05"]), ("MM/dd/yyyy", ["2024-05-01"])]
)
def test_dates(spark, date_format, kept):
    texts = [("2024-01-05",), ("bad",), ("",), (None,), ("05/01/2024",)]
    out = parse_dates(spark.createDataFrame(texts, "date string"), date_format)
    assert [str(r[0]) for r in out.collect()] == kept


def test_outliers(spark):
    numbers = [(float(i % 10 + 1),) for i in range(1000)] + [(10000.0,), (None,)]
    out = drop_outliers(spark.createDataFrame(numbers, "units_sold double"))
    assert out.agg(F.max("units_sold"), F.count("*")).first() == (10.0, 1000)


def test_daily_sales(sales):
    raw = sales(
        ("2024-01-01", 2, {"selling_price": 6.0}),
        ("2024-01-01", 3, {"selling_price": 8.0}),
        ("2024-01-02", 4),
        ("2024-01-02", 9, {"product_id": None}),
        ("2024-01-02", 9, {"category": None}),
    )
    rows = daily_sales(raw).orderBy("date").collect()
    assert [(r.units_sold, r.transaction_count, r.selling_price) for r in rows] == [
        (5.0, 2, 7.0),
        (4.0, 1, 8.0),
    ]
    assert rows[0].price_volatility == pytest.approx(2**0.5)
    assert (rows[0].min_price, rows[0].max_price, rows[0].mrp, rows[0].mrp_std) == (6, 8, 10, 0)
    assert rows[1].price_volatility == 0.0 and rows[1].mrp_std is None


def test_inventory_join(spark, sales):
    stock = spark.createDataFrame(
        [("p1", "x", 3.0), ("p1", "x", 4.0), (None, "x", 9.0), ("p2", "x", None)], INVENTORY
    )
    totals = inventory_stock(stock)
    assert sorted(values(totals, "product_id", "stock_quantity")) == [("p1", 7.0), ("p2", 0.0)]
    daily = daily_sales(sales(("2024-01-01", 1), ("2024-01-01", 1, {"product_id": "p9"})))
    out = join_inventory(daily, totals)
    assert sorted(values(out, "product_id", "stock_quantity")) == [("p1", 7.0), ("p9", 0.0)]


@pytest.mark.parametrize("fill", [impute_median, fill_prices])
def test_medians(spark, sales, fill):
    raw = sales(
        ("2024-01-01", 1, {"selling_price": 2.0}),
        ("2024-01-02", 1, {"selling_price": None}),
        ("2024-01-03", 1, {"selling_price": 4.0, "city_name": "y"}),
        ("2024-01-01", 1, {"product_id": "p2", "selling_price": None, "mrp": None}),
        ("2024-01-01", 1, {"product_id": "p3", "selling_price": 9.0}),
    )
    out = fill(materialize(daily_sales(raw), "test"))
    got = {(r.product_id, r.date.day): (r.selling_price, r.mrp) for r in out.collect()}
    assert got[("p1", 2)] == (3.0, 10.0)  # both cities of the product
    assert got[("p2", 1)] == (4.0, 10.0)  # median of 2, 4, 9
    assert got[("p1", 1)] == (2.0, 10.0)


def test_profile_and_values(spark, sales):
    raw = sales(("2024-01-01", 1), ("2024-03-01", 1, {"city_name": None}))
    stock = spark.createDataFrame([("p1", "x", 3.0)], INVENTORY)
    got = {r.table_name: r for r in table_profile({"sales": raw, "inventory": stock}).collect()}
    assert got["sales"].row_count == 2 and str(got["sales"].max_date) == "2024-03-01"
    assert got["inventory"].min_date is None
    assert values(dim_values(raw), "column", "value") == [("city_name", "x"), ("product_id", "p1")]


def test_csv_input(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(
        " Date ,City Name,Product_ID,Product_Name,Category,Sub_Category,Units Sold,MRP,Selling Price\n"
        '2024-01-05,x,007,"a ""b"", c",c1,s1,3,10,n/a\n'
        "bad,x,1,n,c1,s1,3,10,9\n"
        "2024-01-06,x,8,n,NA,s1,oops,10,9\n"
    )
    rows = read_sales(spark, str(tmp_path / "sales.csv")).orderBy("date").collect()
    assert len(rows) == 2
    assert rows[0].product_id == "007" and rows[0].product_name == 'a "b", c'
    assert rows[0].selling_price is None and rows[0].units_sold == 3.0
    assert rows[1].category is None and rows[1].units_sold is None
    (tmp_path / "inv.csv").write_text("product_id,city_name\n1,x\n")
    with pytest.raises(ValueError, match="stock_quantity"):
        read_inventory(spark, str(tmp_path / "inv.csv"))


def test_scratch_tables_are_removed(spark):
    def folders():
        return {p.name for p in pathlib.Path(shared_folder(spark)).iterdir()}

    before = folders()
    with scratch(spark) as store:
        assert store(spark.range(5), "five").count() == 5
        assert folders() - before
    assert folders() == before
