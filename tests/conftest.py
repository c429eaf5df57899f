import datetime
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from demandcast.schema import SALES  # noqa: E402
from demandcast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        sql__shuffle__partitions="4",
        ui__enabled="false",
        ui__showConsoleProgress="false",
        driver__memory="8g",
        checkpoint__dir=tempfile.mkdtemp(prefix="run-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sales(spark):
    """Build a sales table from (date, units) and overrides per row."""

    def build(*rows, **common):
        out = []
        for row in rows:
            day, units, own = row[0], row[1], (row[2] if len(row) > 2 else {})
            values = {
                "date": datetime.date.fromisoformat(day),
                "product_id": "p1",
                "product_name": "Product 1",
                "category": "c1",
                "sub_category": "s1",
                "city_name": "x",
                "units_sold": None if units is None else float(units),
                "selling_price": 8.0,
                "mrp": 10.0,
                **common,
                **own,
            }
            out.append(tuple(values[f.name] for f in SALES))
        return spark.createDataFrame(out, SALES)

    return build


def days(n, start="2024-01-01"):
    first = datetime.date.fromisoformat(start)
    return [(first + datetime.timedelta(days=i)).isoformat() for i in range(n)]


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
