"""CSV inputs."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from demandcast.operators.clean import normalize_columns, nulls_for_nan, parse_dates
from demandcast.operators.dates import parse_inferred
from demandcast.schema import INVENTORY, SALES

# Texts that stand for a missing value in CSV input.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with normal headers and missing values as null.

    Only the header line is read up front; columns are found by name, in any
    order.
    """
    raw = spark.read.csv(path, header=True, escape='"')
    df = normalize_columns(raw)
    return df.select(*[F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) for c in df.columns])


def _typed(df: DataFrame, schema) -> DataFrame:
    absent = [f.name for f in schema if f.name not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    columns = []
    for f in schema:
        value = F.col(f.name)
        if f.dataType.simpleString() == "double":
            value = value.try_cast("double")
        columns.append(value.alias(f.name))
    return nulls_for_nan(df.select(*columns))


def placed_csv(spark: SparkSession, path: str) -> DataFrame:
    """read_csv() and `_place`, by which rows stand as in their files, files by path."""
    raw = spark.read.csv(path, header=True, escape='"')
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    df = raw.select("*", place.alias("_place"))
    names = normalize_columns(raw).columns
    return df.toDF(*names, "_place").select(
        *[F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) for c in names], "_place"
    )


def read_sales(spark: SparkSession, path: str, date_format: str | None = "yyyy-MM-dd") -> DataFrame:
    """Sales rows with a valid date; ids stay text, bad numbers become null.

    Without a format (None) the first date text decides it; quarantined_sales() has
    the rows that do not fit.
    """
    if date_format is None:
        return _typed(parse_inferred(placed_csv(spark, path), ("_place",))[0], SALES)
    return parse_dates(_typed(read_csv(spark, path), SALES), date_format)


def quarantined_sales(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the sales rows that read_sales(date_format=None) leaves out, as text, and the
    reason; `_place` says where they stand."""
    return parse_inferred(placed_csv(spark, path), ("_place",))[1]


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return _typed(read_csv(spark, path), INVENTORY)
