"""Exact quantiles with linear interpolation, for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
aggregation buffer. Here equal values are first counted map-side. The counted
values are cut into pieces along their order, the piece sizes tell which pieces
hold the wanted ranks, and only those pieces are sorted. A group that holds a
large share of the values is spread over as large a share of the pieces.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from demandcast.operators.ordering import PIECES, split_keys, with_piece


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: tuple[str, ...] = (),
    few_groups: bool = False,
    pieces: int = PIECES,
) -> DataFrame:
    """One row per group (keys must be non-null) with one column per quantile.

    `few_groups` says that the number of groups is fixed by the query, not by
    the data, so that the wanted pieces may be broadcast.
    """
    by = list(by)
    v = F.col(value).cast("double")
    counted = (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*by, v.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    order = [*by, "_v"]
    placed = with_piece(counted, order, split_keys(counted, order, pieces))

    ranks = {}
    for name, p in probabilities.items():
        exact = F.lit(float(p)) * (F.col("_total") - 1)
        ranks[name] = (F.floor(exact), F.ceil(exact), exact)
    held = F.lit(False)
    for low, high, _ in ranks.values():
        for rank in (low, high):
            end = F.col("_before") + F.col("_size")
            held = held | ((rank >= F.col("_before")) & (rank < end))

    # A group has at most `pieces` rows here, and mostly one.
    group = W.partitionBy(*by)
    earlier = group.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    wanted = (
        placed.groupBy(*by, "_piece")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_total", F.sum("_size").over(group))
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .where(held)
        .select(*by, "_piece", "_before", "_total")
    )
    if few_groups or not by:
        wanted = F.broadcast(wanted)  # two pieces per group and quantile at most

    inside = W.partitionBy(*by, "_piece").orderBy("_v")
    start = F.col("_before") + F.coalesce(
        F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    spans = placed.join(wanted, [*by, "_piece"]).withColumn("_start", start)

    def value_at(rank):
        found = (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_n"))
        return F.max(F.when(found, F.col("_v")))

    picked = spans.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[value_at(low).alias(f"_low_{n}") for n, (low, _, _) in ranks.items()],
        *[value_at(high).alias(f"_high_{n}") for n, (_, high, _) in ranks.items()],
    )

    # low + (high - low) * part keeps a repeated value exactly as it is.
    def between(name, low, exact):
        first, second = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return (first + (second - first) * (exact - low)).alias(name)

    return picked.select(*by, *[between(n, low, exact) for n, (low, _, exact) in ranks.items()])
