"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm.common import table


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b): the smallest id reachable.

    Alternating star contraction: every node hands its larger neighbours, then its smaller ones, to the smallest it
    sees, until nothing moves.  Each round is two joins with pre-aggregated minima; rounds grow with the logarithm of
    the size.  Edges with a null end and loops say nothing and are left out.
    """
    edges = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = table(large.where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = table(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("a")).first()
        if state[0] == state[2] and state == before:
            break
        before = state
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
