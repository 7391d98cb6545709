"""Connected components of a graph given as edges between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _with_min(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, m): m is the least of u and all its neighbours; and the written table of least ones. As that is written, the join has an exchange of its own on both sides, and AQE can split a hub's edges."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "cc-least")
    return edges.join(least, edges.u == least.w).select("u", "v", "m"), least


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Alternate large-star and small-star steps until nothing moves.

    edges: columns (u, v), longs, any direction, repeats allowed. Returns (node, root) for every node of an edge, root
    the least node of its component. Each round is written to the shared folder, and the round before is deleted.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        met, first = _with_min(both)
        large = written(met.where("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct(), "cc-large")
        small, second = _with_min(large)
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(after, "cc")
        done = _sums(after) == _sums(now)
        for old in (now, first, large, second):
            dropped(old)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sums(edges: DataFrame) -> tuple:
    """Equal only if the edge sets are: count and the exact sum of edge hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
