"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pepspark.llm.common import drop_staged, staged


def is_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge at most to a smaller one (a to b), and none of those has one itself."""
    if not edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b): the least node of its component.

    Each round joins every node's larger neighbours to its least neighbour, then its smaller ones, until all that is left
    are stars.  Minima are combined before the shuffle and staged before they are joined back, so that a node of any
    degree is no hot task.  Rounds are staged tables; the driver learns only whether they are stars yet.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not is_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "large")
        smallest = staged(large.groupBy("a").agg(F.min("b").alias("m")), "smallest")
        small = large.join(smallest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = staged(small, "small")
        for done in (now, least, large, smallest):
            drop_staged(done)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
