"""Positions and running totals over a global order, without one global sort.

A window without PARTITION BY sends every row to one task. Here the order is
cut into pieces at split keys; each piece is summed by a partial aggregate, the
few piece totals are accumulated, and only then are rows ordered inside their
piece. Any split keys give the exact answer, they only decide how even the
pieces are, so a small hash sample of the keys is enough.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SIDE = 16
PIECES = SIDE * SIDE


def order_key(order: list[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def split_keys(df: DataFrame, order: list[str], pieces: int = PIECES) -> Column:
    """Scalar subquery: sorted array of less than `pieces` sampled order keys.

    The rows with the lowest key hash are a uniform sample that stays the same
    when a lost task is run again. Ordering by all columns keeps them in this
    plan, so that it shares its shuffle with the plan that reads the pieces.
    """
    sample = df.orderBy(F.xxhash64(*order), *df.columns).limit(pieces - 1)
    return sample.agg(F.sort_array(F.collect_list(order_key(order)))).scalar()


def _count_at_or_below(key: Column, split, low: int, high: int) -> Column:
    """Binary search as nested conditions, which compile to plain code."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(
        F.coalesce(split(middle) <= key, F.lit(False)),
        _count_at_or_below(key, split, middle + 1, high),
    ).otherwise(_count_at_or_below(key, split, low, middle))


def with_piece(df: DataFrame, order: list[str], splits: Column) -> DataFrame:
    """Add `_piece`, the number of split keys at or below the row's key.

    It never falls as the key grows. The search finds a block of SIDE splits
    first and the place in the block second. The result is never null: joins
    on a nullable expression would push a null test, and the search with it,
    below the aggregate that feeds them.
    """
    key = order_key(order)
    block = _count_at_or_below(
        key, lambda i: F.get("_splits", F.lit(SIDE * i + SIDE - 1)), 0, SIDE - 1
    )
    place = _count_at_or_below(
        key, lambda i: F.get("_splits", F.col("_block") * SIDE + i), 0, SIDE - 1
    )
    return (
        df.withColumn("_splits", splits)
        .withColumn("_block", block)
        .withColumn("_piece", F.coalesce(F.col("_block") * SIDE + place, F.lit(0)))
        .drop("_splits", "_block")
    )


def preceding_total(
    df: DataFrame, order: list[str], amount: str, name: str, pieces: int = PIECES
) -> DataFrame:
    """Add `name`: the sum of `amount` over all rows before this one.

    Rows must be unique in `order` and free of nulls there.
    """
    placed = with_piece(df, order, split_keys(df, order, pieces))
    earlier = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    # At most `pieces` rows, so the unpartitioned window and the broadcast
    # have a fixed bound.
    offsets = (
        placed.groupBy("_piece")
        .agg(F.sum(amount).alias("_size"))
        .select("_piece", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("_piece").orderBy(*order)
    before = F.sum(amount).over(inside.rowsBetween(W.unboundedPreceding, -1))
    return (
        placed.join(F.broadcast(offsets), "_piece")
        .withColumn(name, F.col("_offset") + F.coalesce(before, F.lit(0)))
        .drop("_piece", "_offset")
    )
