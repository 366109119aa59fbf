"""Connected components of edges, each node under the smallest it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import saved


def _settled(links: DataFrame) -> bool:
    """Whether each node above has one node below, and no node is both."""
    roles = links.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.filter("up > 1 or (up = 1 and down = 1)").limit(1).count()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b): the smallest node reachable.

    A round links the larger neighbours of each node to its smallest one (large star), then each node and its smaller
    neighbours to the smallest of these (small star). Either keeps what is connected, and a chain halves in a round,
    whatever the order of its ids. It ends when only stars around their smallest node are left; RuntimeError if
    ``rounds`` don't suffice. Every step is written, so that a lost executor costs one step.
    """
    given = saved(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges")
    links = given.filter("high <> low")
    done = _settled(links)
    for _ in range(rounds):
        if done:
            break
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy(F.col("high").alias("low")).agg(F.min("low").alias("m")).select("low", F.least("low", "m").alias("m"))
        links = saved(links.join(least, "low").select("high", F.col("m").alias("low")).distinct(), "large-star")
        least = links.groupBy("high").agg(F.min("low").alias("m"))
        below = links.join(least, "high").filter("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        links = saved(below.unionByName(least.select("high", F.col("m").alias("low"))).distinct(), "small-star")
        done = _settled(links)
    if not done:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    nodes = given.select(F.col("high").alias("node")).unionByName(given.select(F.col("low").alias("node"))).distinct()
    return saved(nodes.join(links.withColumnRenamed("high", "node"), "node", "left").select("node", F.coalesce("low", "node").alias("component")), "components")
