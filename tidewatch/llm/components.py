"""Connected components of a link table by alternating stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.storage import staged


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest node around it."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = near.filter(F.col("b") > F.col("a")).join(least, "a")
    return tied.select(F.col("m").alias("a"), "b").filter(F.col("a") != F.col("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return tied.unionByName(own).filter(F.col("a") != F.col("b")).distinct()


def _digest(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b`` (longs, any direction, repeats allowed).

    The component is its smallest node.  Each round halves the distance to it or better, and is
    written to the shared folder; only a count and sums of hashes of the links come to the driver.  Links
    of a node to itself are ignored, and nodes without other links are not in the result.
    """
    links = links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    links = staged(links.filter(F.col("a") != F.col("b")).distinct(), "links")
    before = _digest(links)
    while before[0]:
        links = staged(_small_star(_large_star(links)), "links")
        now = _digest(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
