"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour to the least node of its star; minima come from partial sums and reach a star's links by a join that Spark splits where a star is hot."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        lower = both.filter("b < a")
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        out = lower.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the least node that it reaches.

    Ends when a round changes no link; loops and repeated links do no harm.
    Only the last round's links stay in the shared folder.
    """
    links = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    said = None
    for _ in range(most_rounds):
        before, links = links, settle(_stars(_stars(links, True), False), "links")
        discard(links.sparkSession, before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == said:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        said = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
