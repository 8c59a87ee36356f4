"""Connected components by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for every end of an edge (u, v): root is the least id that u can reach.

    Rounds go on until one changes nothing (of a chain, each halves the length at least). Self-loops are
    ignored. Each round is materialised in the shared folder. A hub's neighbours are
    joined, never collected, so adaptive skew joins can split them.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return edges.select("u", F.col("v").alias("root")).union(roots)
