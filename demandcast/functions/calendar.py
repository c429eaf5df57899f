"""Date parts used as model inputs."""

from pyspark.sql import Column, functions as F

# Quarter-like seasons, December to February first.
SEASONS = ("winter", "spring", "summer", "autumn")


def season(date) -> Column:
    """Meteorological season: winter holds December, January and February."""
    index = F.floor((F.month(date) % 12) / 3).cast("int") + 1
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), index)


def calendar_columns(date="date") -> dict[str, Column]:
    day = F.dayofmonth(date)
    weekday = F.weekday(date)  # Monday is 0
    return {
        "day_of_week": weekday,
        "day_of_month": day,
        "month": F.month(date),
        "quarter": F.quarter(date),
        "week_of_year": F.weekofyear(date),  # ISO week
        "is_weekend": (weekday >= 5).cast("int"),
        "is_month_start": (day <= 7).cast("int"),  # the first week
        "is_month_end": (day >= 24).cast("int"),
        "season": season(date),
    }
