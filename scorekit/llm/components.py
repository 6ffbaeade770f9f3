"""Connected components of a graph given as an edge table, by rounds of star operations.

Each round replaces a node's links by links to the smallest node around it (large star), then
does the same among the smaller neighbours (small star); the number of rounds grows with the
logarithm of the longest path. Every round is written to the shared folder, so a lost
executor costs one round at most, and no plan grows with the number of rounds. A node with a
third of all links is reduced by partial aggregation before the shuffle; its links are joined,
not collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.session import delete_tables, materialize


def _star(links: DataFrame, keep_larger: bool) -> DataFrame:
    """Links ``a, b`` (both directions given as needed) turned to the least node around ``a``."""
    least = links.groupBy("a").agg(F.min("b").alias("least")).withColumn(
        "least", F.least("least", "a"))
    joined = links.join(least, "a")
    if keep_larger:
        turned = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        turned = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b")))
    return turned.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has an edge; ``root`` is the least node reachable.

    ``edges`` has two columns ``a, b`` of one orderable type; direction and repeats don't matter,
    nulls and loops are left out.
    """
    now = materialize(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    nodes = materialize(nodes, "nodes")
    seen = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialize(_star(both, keep_larger=True), "links")
        small = materialize(_star(large, keep_larger=False), "links")
        mark = _mark(small)
        delete_tables(now.sparkSession, now, large)
        now = small
        if mark == seen:
            break
        seen = mark
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))


def _mark(links: DataFrame) -> tuple:
    """Number and checksum of the links: equal marks before and after a round mean that it
    changed nothing."""
    r = links.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]
