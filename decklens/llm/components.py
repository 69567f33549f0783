"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklens.llm.common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has a link, with the smallest node it can reach.

    Each step replaces links by links to the smallest neighbour and so keeps what is connected; it
    ends when every node links to its component only. Steps are aggregates and joins on one key
    with partial sums; the links of each step are written to the shared folder, which cuts the
    lineage, and the driver sees two numbers per step. Links of a node with itself are ignored.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Large star: each larger neighbour of a node links to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        star = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: each smaller neighbour of a node, and the node, link to the smallest of them.
        small = star.groupBy("a").agg(F.min("b").alias("low"))
        edges = staged(
            star.join(small, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first()
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
