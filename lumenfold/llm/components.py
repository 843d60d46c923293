"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import scratch

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    out = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b")))
    return out.distinct()


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link.

    `edges` has columns a, b of any ordered type without nulls. Rounds follow the logarithm of the
    longest path; each is written to the shared folder, and what comes to the driver is a checksum.
    Hot nodes are counted map-side and joined in plain joins, which adaptive execution splits.
    """
    current = scratch.keep(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = digest(current)
    if before[0]:
        for _ in range(MAX_ROUNDS):
            current = scratch.keep(_small_star(_large_star(current)))
            now = digest(current)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
