"""Connected components of an edge table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.session import materialize


def _least_neighbour(edges: DataFrame, both_ways: bool) -> DataFrame:
    """For each node `u`, the least of itself and its neighbours in `edges` (u > v)."""
    pairs = edges.select("u", "v")
    if both_ways:
        pairs = pairs.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("least"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has either one lesser neighbour, or only greater ones."""
    up = edges.select("u", F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("n")))
    nodes = up.groupBy("u").agg(F.sum("n").alias("lesser"), F.count("*").alias("all"))
    # A node with a lesser neighbour is a leaf: that edge is its only one.
    return nodes.where("lesser > 0 AND `all` > 1").isEmpty()


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """(node, `label`): for every node of `edges` (a, b) the least node it is connected with.

    Nodes may be of any ordered type. Null ends, loops and repeated edges are
    ignored, so nodes with no other edge are absent; an empty table gives an
    empty one.

    Each round is two grouped minima and joins back on the node, with no group
    gathered: a hub's edges are combined before the shuffle, and its rows in the
    join are split by adaptive execution. Rounds grow with the logarithm of the
    longest chain and end when the edges are stars. Every round is stored in the shared folder, so a lost executor
    costs one round.
    """
    kind = edges.schema["a"].dataType
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(start, "edges")
    while not _all_stars(edges):
        # Large star: greater neighbours of a node go to its least neighbour.
        least = _least_neighbour(edges, both_ways=True)
        greater = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = greater.join(least, "u").select(F.col("w").alias("u"), F.col("least").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "edges")
        # Small star: a node and its lesser neighbours go to the least of them.
        least = _least_neighbour(large, both_ways=False)
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            joined.select("u", F.col("least").alias("v"))
        )
        edges = materialize(small.where("u <> v").distinct(), "edges")
    heads = edges.select("v").distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias(label)).unionByName(
        heads.select(F.col("v").alias("node"), F.col("v").alias(label))
    )
    return found.select(F.col("node").cast(kind).alias("node"), label)
