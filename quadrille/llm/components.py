"""Connected components by alternating large-star and small-star.

Every step is an aggregation that combines on the map side and an equi-join
on a node, so a node with very many neighbours is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt_anew, saved


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (``a``, ``b`` long) that has a neighbour.

    ``component`` is the smallest node that can be reached.  Loops and repeated
    edges are allowed, edges with a null end are ignored, and an empty input
    gives an empty result.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = saved(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    state = _sum(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(dealt_anew(low, "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt_anew(low, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.union(low).where("a <> b").distinct(), "edges")
        before, state = state, _sum(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )
