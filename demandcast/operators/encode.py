"""Label codes of categorical columns."""

from pyspark.sql import DataFrame, functions as F

from demandcast.operators.ordering import preceding_total
from demandcast.schema import ENCODED


def fit_vocabulary(df: DataFrame, columns=ENCODED) -> DataFrame:
    """(column, value, code): code is the rank of the text among its column's values.

    One pass finds the distinct pairs of all columns; ranks come from positions
    in the order (column, value), so a vocabulary of any size is spread out.
    """
    pairs = (
        df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column"), F.col(c).cast("string").alias("value")
                        )
                        for c in columns
                    ]
                )
            ).alias("pair")
        )
        .select("pair.*")
        .dropna()
        .distinct()
        .withColumn("_one", F.lit(1))
    )
    placed = preceding_total(pairs, ["column", "value"], "_one", "_position")
    # One row per encoded column.
    first = placed.groupBy("column").agg(F.min("_position").alias("_first"))
    return placed.join(F.broadcast(first), "column").select(
        "column", "value", (F.col("_position") - F.col("_first")).cast("int").alias("code")
    )


#: The code of every value outside the vocabulary, missing ones included; fitted codes start at 0.
UNSEEN = -1
#: Columns whose vocabulary has a fixed, small size.
FEW_VALUES = ("season",)


def label_encode(df: DataFrame, vocabulary: DataFrame, columns=ENCODED) -> DataFrame:
    """Add `<column>_enc`; a value outside the vocabulary gets UNSEEN."""
    for c in columns:
        codes = vocabulary.where(F.col("column") == c).select(
            F.col("value").alias(f"_value_{c}"), F.col("code").alias(f"{c}_enc")
        )
        codes = F.broadcast(codes) if c in FEW_VALUES else codes
        df = df.join(codes, F.col(c).cast("string") == F.col(f"_value_{c}"), "left").drop(
            f"_value_{c}"
        )
        df = df.withColumn(f"{c}_enc", F.coalesce(f"{c}_enc", F.lit(UNSEEN)))
    return df
