"""Connected components by alternating large-star and small-star steps, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def _least_neighbour(edges: DataFrame, own: bool) -> DataFrame:
    """The smallest neighbour (or own id) of each node; sums in each task first, so hot nodes are no burden."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return least.select("u", F.least("u", "m").alias("m")) if own else least


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it reaches) for each node of a link; ids are longs.

    Links may repeat, stand in either direction or link a node with itself; nulls are left out. No links: no rows.
    """
    edges = staged(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc_edges")
    mark = None
    for _ in range(most_rounds):
        both = edges.filter("u <> v").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both, True), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small_min = _least_neighbour(large, False)
        small = large.join(small_min, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = staged(small.filter("u <> v").distinct(), "cc_edges")
        got = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark is not None:
            drop_staged(edges)
        edges, last, mark = after, mark, (got["n"], got["h"])
        if last == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
