"""Connected components of a large edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from canopy.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller end, so a row's ``v`` lies below its ``u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u")
    return down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """``u, root`` for every vertex of ``links (a long, b long)`` but the roots themselves.

    The root is the smallest vertex of its component. Each round halves paths at least, so rounds
    follow the logarithm of the longest one; every round is a table in the shared folder. Links of
    a vertex with itself and repeated links change nothing; no links give an empty table.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where("a != b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, label)
    state = None
    while True:
        told = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if tuple(told) == state or not told[0]:
            return edges.select("u", F.col("v").alias("root"))
        state = tuple(told)
        edges = written(_small_star(_large_star(edges).distinct()).where("u != v").distinct(), label)
