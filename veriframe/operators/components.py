"""Connected components of a link table by alternating large-star and small-star steps, all of it in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, release

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them. Edges come as (u, v) with v < u."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    near = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return near.unionByName(low.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v), root being the smallest node of its component, which is also a row.

    Node ids are any ordered non-null type; self-links are dropped. Minima are aggregated before they are joined back, so
    a hub of any degree costs partial aggregates only. Rounds end when a step changes no edge; edges are counted and
    summed as hashes, and only those two numbers reach the driver. Every round is a table in the shared folder.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or now[0] == 0:
            break
        mark = tuple(now)
        after = materialize(_small_star(_large_star(edges)), "edges")
        release(edges.sparkSession, edges)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
