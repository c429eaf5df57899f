"""Preparing rows for fitted models and explaining their forecasts."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from demandcast.functions.text import contribution_lines, explanation
from demandcast.operators.history import recent_history
from demandcast.schema import FEATURES, SERIES, SERIES_ORDER

PROMPT_ROWS = 8
# History columns shown in an explanation when a table has them.
PROMPT_COLUMNS = ("date", "qty", "sales")


# Plain decimal numbers; the cast alone would also take type suffixes such as `1d`.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def aligned(df: DataFrame, feature: str) -> Column:
    """One model input as a number: 0 where it is missing, null or not a number.

    Columns of other types than numbers, booleans and text (dates, arrays) are 0.
    """
    if feature not in df.columns:
        return F.lit(0.0)
    kind = dict(df.dtypes)[feature]
    if kind == "string":
        number = F.when(F.col(feature).rlike(NUMBER), F.trim(feature).try_cast("double"))
    elif kind == "boolean" or isinstance(df.schema[feature].dataType, NumericType):
        number = F.col(feature).cast("double")
    else:
        return F.lit(0.0)
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))


def align_features(df: DataFrame, features=FEATURES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the model inputs in model order, after the `keep` columns."""
    return df.select(*keep, *[aligned(df, f).alias(f) for f in features])


def contributions(df: DataFrame, models: dict[str, str]) -> DataFrame:
    """(product_id, city_name, model, value): each model's share, two decimals."""
    return df.select(
        *SERIES,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("model"),
                        F.format_string("%.2f", F.col(c).cast("double")).alias("value"),
                    )
                    for m, c in models.items()
                ]
            )
        ).alias("row"),
    ).select(*SERIES, "row.*")


def recent_csv(
    history: DataFrame,
    columns: tuple[str, ...] | None = None,
    rows: int = PROMPT_ROWS,
    ties: tuple[str, ...] = SERIES_ORDER[1:],
) -> DataFrame:
    """(product_id, city_name, recent): the last rows of each pair as CSV text."""
    if columns is None:
        columns = tuple(c for c in PROMPT_COLUMNS if c in history.columns) or tuple(
            history.columns
        )
    lines = (
        recent_history(history, rows, ties)
        .groupBy(*SERIES)
        .agg(
            # At most `rows` rows per pair are left here.
            F.sort_array(
                F.collect_list(
                    F.struct(
                        (-F.col("recency")).alias("place"),
                        F.concat_ws(
                            ",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
                        ).alias("line"),
                    )
                )
            ).alias("lines")
        )
    )
    text = F.concat(
        F.lit(",".join(columns) + "\n"), F.array_join("lines.line", "\n"), F.lit("\n")
    )
    return lines.select(*SERIES, text.alias("recent"))


def explain_prompt(
    forecasts: DataFrame,
    history: DataFrame,
    predicted: str,
    models: dict[str, str],
    columns: tuple[str, ...] | None = None,
    ties: tuple[str, ...] = SERIES_ORDER[1:],
) -> DataFrame:
    """The explanation request for every forecast row."""
    joined = forecasts.join(recent_csv(history, columns, ties=ties), list(SERIES), "left")
    recent = F.coalesce("recent", F.lit(""))
    return joined.select(
        *SERIES,
        explanation(
            "city_name", "product_id", predicted, contribution_lines(models), recent
        ).alias("prompt"),
    )
