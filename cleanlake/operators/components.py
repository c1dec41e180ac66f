"""Connected components by alternating large stars and small stars, with hubs apart.

Edges point from the larger node to the smaller one. A large star ties every larger neighbour of a node to the smallest node around it, a small star
every smaller neighbour and the node itself; both keep the components and shorten the paths, and after O(log^2 n) rounds every component is one
star around its smallest node. The minima are grouped aggregations, combined map-side. They meet the edges again by an equi join, but for hubs: the
at most HUBS nodes with HUB_ROWS edges or more are looked up in a broadcast table of that many rows, so that no task gets the edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import discard, scratch_path

HUBS = 1_024
HUB_ROWS = 10_000


def _around(edges: DataFrame, key: str, least: DataFrame, hub_rows: int) -> DataFrame:
    """edges with the minimum `m` of their `key`; least has key, m, n (edges of the key)."""
    hubs = least.where(F.col("n") >= hub_rows).orderBy(F.col("n").desc(), key).limit(HUBS).select(F.col(key), F.col("m").alias("hub_m"))
    if hubs.isEmpty():
        return edges.join(least.select(key, "m"), key)
    marked = edges.join(F.broadcast(hubs), key, "left")
    rest = marked.where("hub_m is null").drop("hub_m").join(least.select(key, "m"), key)
    return marked.where("hub_m is not null").withColumnRenamed("hub_m", "m").unionByName(rest)


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "star-edges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """node, label of every node of the edges (left, right): the smallest node that it is connected with.

    Edges may repeat, point either way or loop; nulls are no nodes. A node that has only loops is its own component. No edges give no rows.
    """
    pairs = edges.where("left is not null and right is not null").select("left", "right")
    now, path = _kept(pairs.where("left <> right").select(F.greatest("left", "right").alias("a"), F.least("left", "right").alias("b")).distinct())
    alone, alone_path = _kept(pairs.where("left = right").select(F.col("left").alias("a")).distinct())
    seen = None
    while True:
        ends = now.select(F.col("b").alias("x"), F.col("a").alias("y")).unionByName(now.select(F.col("a").alias("x"), F.col("b").alias("y")))
        near = ends.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("x", "b")
        large, large_path = _kept(_around(now, "b", near, hub_rows).select("a", F.col("m").alias("b")).distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        tied = _around(large, "a", down, hub_rows).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small, small_path = _kept(tied.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        discard(path)
        discard(large_path)
        now, path = small, small_path
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:        # a round that changes nothing: every component is a star
            break
        seen = state
    roots = now.select(F.col("b").alias("a")).distinct().unionByName(alone.join(now, "a", "left_anti").select("a")).distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))
    out, _ = _kept(now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots))
    discard(path)
    discard(alone_path)
    return out
