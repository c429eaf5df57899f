"""Rounding for value comparison, the same arithmetic as in the SQL text.

The two engines add up doubles in different orders, so a mean may differ in its
last bit. Rounding half up would turn that bit into a visible difference
whenever a mean lies exactly half way, as means of two-decimal prices do. CUT
puts the rounding border where no such value lies.
"""

from pyspark.sql import DataFrame, functions as F

CUT = 0.318


def rounded(df: DataFrame, scale: int, *columns: str) -> DataFrame:
    """Whole multiples of 1/scale; inf and null are left alone."""
    return df.withColumns(
        {
            c: F.when(F.abs(F.col(c)) < 1e300, F.floor(F.col(c) * scale + CUT) / scale).otherwise(
                F.col(c)
            )
            for c in columns
        }
    )


def rounded_sql(column: str, scale: int, name: str | None = None) -> str:
    return f"floor(({column}) * {scale} + CAST({CUT} AS DOUBLE)) / {scale} AS {name or column}"
