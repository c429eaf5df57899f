import pytest

from demandcast.operators.dates import FORMATS, chosen_format, date_formats, parse_inferred
from demandcast.sources.tables import quarantined_sales, read_sales


def parsed(spark, *texts, rule="first"):
    """(dates by row number, reasons by row number)."""
    df = spark.createDataFrame(list(enumerate(texts)), "n int, date string")
    rows, bad = parse_inferred(df, ("n",), rule=rule)
    return {r["n"]: str(r["date"]) for r in rows.collect()}, {r["n"]: r["reason"] for r in bad.collect()}


@pytest.mark.parametrize(
    "texts,dates,reasons",
    [
        # The first text decides; an ambiguous one is read month first.
        (("05/01/2024", "2024-01-05"), {0: "2024-05-01"}, {1: "other format"}),
        (("13/01/2024", "05/01/2024", "01/13/2024"), {0: "2024-01-13", 1: "2024-01-05"}, {2: "other format"}),
        (
            (None, "  ", "2024-01-05", "5.1.2024", "bad", "2024-02-30", "2024-01-05"),
            {2: "2024-01-05", 6: "2024-01-05"},
            {0: "missing", 1: "missing", 3: "other format", 4: "no date", 5: "no date"},
        ),
        # No candidate fits the first text.
        (("soon", "2024-01-05"), {}, {0: "no date", 1: "other format"}),
        ((None, ""), {}, {0: "missing", 1: "missing"}),
        ((), {}, {}),
    ],
)
def test_first_text_decides(spark, texts, dates, reasons):
    assert parsed(spark, *texts) == (dates, reasons)


def test_most_texts_decide(spark):
    texts = ("soon", "05/01/2024", "2024-01-05", "2024-01-06")
    dates, reasons = parsed(spark, *texts, rule="most")
    assert dates == {2: "2024-01-05", 3: "2024-01-06"}
    assert reasons == {0: "no date", 1: "other format"}
    # Equal counts: the first candidate.
    assert parsed(spark, "05/01/2024", "2024-01-05", rule="most")[0] == {1: "2024-01-05"}


def test_counts_of_every_format(spark):
    texts = [(3, "1/2/2024"), (1, ""), (2, "14/2/2024"), (4, None)]
    counts = date_formats(spark.createDataFrame(texts, "n int, day string"), "day", ("n",))
    rows = {r["date_format"]: r for r in counts.collect()}
    assert tuple(rows) == FORMATS
    assert {f: r["n_fit"] for f, r in rows.items() if r["n_fit"]} == {"M/d/yyyy": 1, "d/M/yyyy": 2}
    assert {r["n_texts"] for r in rows.values()} == {2}
    assert [f for f, r in rows.items() if r["fits_first"]] == ["d/M/yyyy"]
    assert chosen_format(counts).collect() == [(4, "d/M/yyyy")]
    with pytest.raises(ValueError):
        chosen_format(counts, "last")


def test_sales_of_unknown_format(spark, tmp_path):
    head = "Date, Product ID ,Product Name,Category,Sub Category,City Name,Units Sold,Selling Price,MRP\n"
    lines = [f"{d},p1,n,c,s,x,2,8,10\n" for d in ("NA", "13/01/2024", "02/01/2024", "2024-01-05")]
    (tmp_path / "sales.csv").write_text(head + "".join(lines))
    path = str(tmp_path / "sales.csv")
    rows = read_sales(spark, path, None)
    assert sorted((str(r["date"]), r["units_sold"]) for r in rows.collect()) == [("2024-01-02", 2.0), ("2024-01-13", 2.0)]
    assert rows.columns == read_sales(spark, path).columns
    bad = quarantined_sales(spark, path).orderBy("_place").collect()
    assert [(r["date"], r["reason"]) for r in bad] == [(None, "missing"), ("2024-01-05", "other format")]
