"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.llm.common import stash


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): ``label`` is the smallest node that it can reach.

    Alternates two steps until every node points to its smallest one: every node hands its larger neighbours to its smallest
    neighbour (large star), then its smaller ones (small star). Each round halves the depth of trees, and the
    number of edges never grows. Smallest neighbours combine before the shuffle, and they are written before
    the join, so that both sides of it are plain shuffles and a node with very many edges is split over tasks.
    Nothing but whether it is done reaches the driver.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = stash(edges, "cc-edges")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        smallest = stash(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "cc-smallest")
        large = both.join(smallest, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = stash(large.where("u <> v").distinct(), "cc-large")
        lowest = stash(large.groupBy("v").agg(F.min("u").alias("m")), "cc-lowest")
        small = large.join(lowest, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(lowest.select("v", F.col("m").alias("u")))
        edges = stash(small.where("u <> v").distinct(), "cc-edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node that has none itself."""
    children = edges.select(F.col("v").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    parents = edges.select(F.col("u").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    roles = children.unionByName(parents).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 or (up = 1 and down = 1)").isEmpty()
