"""Connected components by alternating large and small stars, cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written


def _stars(edges: DataFrame) -> bool:
    """Whether no node hangs on two others, or on one that hangs itself; then v is the smallest node of each star."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hung"), F.lit(0).alias("held")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("hung").alias("hung"), F.max("held").alias("held"))
    return not ends.where("hung + held > 1").limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it reaches.

    The number of rounds is logarithmic in the longest path. An edge from a node to
    itself, a repeated edge or a null end changes nothing; no edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    edges = written(edges, "edges")
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least).distinct(), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
