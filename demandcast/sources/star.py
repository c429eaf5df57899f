"""Sales and inventory tables out of a star schema of order lines."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from demandcast.schema import INVENTORY, SALES


# The columns in use. With a given schema no file is opened before the job runs.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_extendedprice double, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string, p_size int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _regions(spark, folder):
    nation, region = _table(spark, folder, "nation"), _table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "r_name"
    )


def star_sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line: brand as product, customer's region as city.

    Join strategies are left to Spark, which knows the file sizes.
    """
    lines = _table(spark, folder, "lineitem")
    orders = _table(spark, folder, "orders")
    customer = _table(spark, folder, "customer")
    part = _table(spark, folder, "part")
    regions = _regions(spark, folder)
    buyers = customer.join(regions, customer.c_nationkey == regions.n_nationkey).select(
        "c_custkey", "r_name"
    )
    dated = orders.join(buyers, orders.o_custkey == buyers.c_custkey).select(
        "o_orderkey", "o_orderdate", "r_name"
    )
    number = F.substring("p_brand", 7, 10).cast("int")
    columns = {
        "date": F.col("o_orderdate").cast("date"),
        "product_id": F.col("p_brand"),
        "product_name": F.concat(F.lit("Product "), number.cast("string")),
        "category": F.concat(F.lit("CAT"), (number % 5).cast("string")),
        "sub_category": F.concat(F.lit("SUB"), (number % 10).cast("string")),
        "city_name": F.col("r_name"),
        "units_sold": F.col("l_quantity"),
        "selling_price": F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity"),
        "mrp": F.col("l_extendedprice") / F.col("l_quantity"),
    }
    joined = lines.join(dated, lines.l_orderkey == dated.o_orderkey).join(
        part, lines.l_partkey == part.p_partkey
    )
    return joined.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in SALES])


def star_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Part size as stock of each (part, supplier) that was ever ordered."""
    pairs = _table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part = _table(spark, folder, "part")
    supplier = _table(spark, folder, "supplier")
    regions = _regions(spark, folder)
    makers = supplier.join(regions, supplier.s_nationkey == regions.n_nationkey).select(
        "s_suppkey", "r_name"
    )
    joined = pairs.join(part, pairs.l_partkey == part.p_partkey).join(
        makers, pairs.l_suppkey == makers.s_suppkey
    )
    columns = {
        "product_id": F.col("p_brand"),
        "city_name": F.col("r_name"),
        "stock_quantity": F.col("p_size"),
    }
    return joined.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in INVENTORY])
