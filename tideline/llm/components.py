"""Connected components over an edge table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One alternating step: a node's neighbours are tied to its smallest neighbour.

    Both steps are a hash aggregate and an equi-join, so a hub's neighbours are never
    gathered in one group; AQE splits the hub's partition in the join.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of each node in links(a, b); component is its smallest node.

    Each round is written to the shared folder. It ends once the edges stop to change, which
    they do after a number of rounds that grows with the logarithm of the nodes.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = cut(_star(_star(edges, True), False))
    stars = edges.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
