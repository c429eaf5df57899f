"""Price ratios and margins."""

from pyspark.sql import Column, functions as F

from demandcast.schema import EPSILON


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a column; null stays null (greatest/least alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def price_columns(selling="selling_price", mrp="mrp") -> dict[str, Column]:
    selling, mrp = F.col(selling), F.col(mrp)
    base = mrp + F.lit(EPSILON)
    return {
        "price_margin": F.coalesce(mrp - selling, F.lit(0.0)),
        "price_ratio": clip(F.try_divide(selling, base), 0.0, 10.0),
        "discount_percent": clip(F.try_divide(mrp - selling, base) * 100, 0.0, 100.0),
    }
