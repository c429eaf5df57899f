"""Dates of text columns whose format is not known beforehand."""

from pyspark.sql import Column, DataFrame, functions as F

# Candidate formats in order of precedence. An ambiguous date is read month first.
FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy",
    "yyyy-M-d H:m:s",
)


def date_of(text: Column, date_format: str) -> Column:
    return F.try_to_timestamp(text, F.lit(date_format)).cast("date")


def filled(text: Column) -> Column:
    """The text, or null where it is blank."""
    return F.when(F.trim(text) != "", text)


def date_formats(
    df: DataFrame, column: str, order: tuple[str, ...], formats: tuple[str, ...] = FORMATS
) -> DataFrame:
    """(place, date_format, n_texts, n_fit, fits_first): every candidate over the whole column.

    n_fit counts the texts that the format fits; fits_first says whether it fits the
    first text in `order`, blank and null ones left out (rows with equal `order`: the
    least text). One pass, aggregated map-side. A column without a text gives zeros
    and false.
    """
    text = df.select(filled(F.col(column)).alias("text"), F.struct(*order).alias("place"))
    found = text.agg(
        F.count("text").alias("n_texts"),
        F.min(F.when(F.col("text").isNotNull(), F.struct("place", "text")))["text"].alias("first"),
        *[F.count(date_of(F.col("text"), f)).alias(f"fit_{k}") for k, f in enumerate(formats)],
    )
    rows = [
        F.struct(
            F.lit(k).alias("place"),
            F.lit(f).alias("date_format"),
            F.col("n_texts"),
            F.col(f"fit_{k}").alias("n_fit"),
            date_of(F.col("first"), f).isNotNull().alias("fits_first"),
        )
        for k, f in enumerate(formats)
    ]
    return found.select(F.inline(F.array(*rows)))


def chosen_format(counts: DataFrame, rule: str = "first") -> DataFrame:
    """(place, date_format) of the format to read by; no row if none fits.

    `first`: the first candidate that fits the first text. `most`: the candidate that
    fits most texts, of equal ones the first.
    """
    if rule not in ("first", "most"):
        raise ValueError(f"unknown rule: {rule}")
    rows = counts.where("fits_first" if rule == "first" else "n_fit > 0")
    rank = F.struct(F.lit(0) if rule == "first" else -F.col("n_fit"), "place", "date_format")
    best = rows.agg(F.min(rank).alias("best")).where("best IS NOT NULL")
    return best.select("best.place", "best.date_format")


def parse_inferred(
    df: DataFrame,
    order: tuple[str, ...],
    column: str = "date",
    formats: tuple[str, ...] = FORMATS,
    rule: str = "first",
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): `df` with `column` as dates of one format, and the rows it does not fit.

    The format is that of chosen_format() over the whole column. Quarantined rows keep
    every column and their text, and have a `reason` at the end: `missing` (null or
    blank), `other format` (another candidate fits), or `no date`. Where no format is
    chosen all rows are quarantined; repeated rows stay repeated, an empty table gives
    two empty ones. Only a column named `reason` clashes: it is replaced in the
    quarantine.
    """
    text = filled(F.col(column))
    best = chosen_format(date_formats(df, column, order, formats), rule).select("place").scalar()
    date = F.coalesce(*[F.when(best == k, date_of(text, f)) for k, f in enumerate(formats)])
    other = F.coalesce(*[date_of(text, f) for f in formats])
    reason = F.when(text.isNull(), "missing").when(other.isNotNull(), "other format").otherwise("no date")
    # withColumn keeps hidden and further columns in their places.
    return df.withColumn(column, date).dropna(subset=[column]), df.where(date.isNull()).withColumn("reason", reason)
