"""Connected components of links between rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.rows import ensure_checkpoint_dir


def _forest(edges: DataFrame, task_rows: int) -> DataFrame:
    """Star edges (u, v) to the least node of what each task's edges connect: fewer edges for the same components."""

    def stars(frames):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for frame in frames:
            for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
        found = [(x, find(x)) for x in [*root]]
        for k in range(0, len(found), 1 << 16):
            yield pd.DataFrame([r for r in found[k : k + (1 << 16)] if r[0] != r[1]], columns=["u", "v"]).astype("int64")

    parts = max(1, -(-edges.count() // task_rows))
    return edges.repartition(parts, "u").mapInPandas(stars, "u long, v long")


def components(edges: DataFrame, task_rows: int = 500_000) -> DataFrame:
    """(u, root) of every end of an edge (u, v) of whole numbers: root is the least that u can reach.

    Each round, tasks of about task_rows edges connect what they hold, whatever its diameter; then every node hands its
    neighbours to the least of them (a small star) and goes on to its neighbour's own least, until a round changes
    nothing. Where one task holds all edges, one round is all."""
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = None
    while True:
        n = now.count()
        stars = _forest(now, task_rows).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        starred = small.union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        above = starred.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        now = starred.join(above, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct().checkpoint()
        told = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if told == state or n <= task_rows:
            break
        state = told
    return now.select("u", F.col("v").alias("root")).union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
