"""Connected components of a graph too large for one machine, by alternating large-star and small-star.

Each node ends up linked with the smallest node of its component. A large-star step links every larger
neighbour of a node with the smallest member of its neighbourhood, a small-star step does so with the
smaller neighbours; both are one aggregate and one join, and both keep the components as they are.
Neighbourhoods are never gathered: the minimum is aggregated and joined back, so a node with a third of
all edges is a join key that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.sources.tables import stage


# Tables of ids hold a small share of the bytes the shuffle partitions are made for, so several go to a task.
NARROW = 16


def stage_narrow(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for a table of a few numbers a row, in fewer tasks and files than the shuffle before it has."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.coalesce(max(8, partitions // NARROW)), name)


def _relinked(edges: DataFrame, smaller: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    both = edges if smaller else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # the aggregate is dealt anew for the join, so that both sides have an exchange and a hot u can be split
    near = both.join(least.withColumnRenamed("u", "w"), F.col("u").eqNullSafe(F.col("w")) & F.col("u").isNotNull())
    if smaller:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    else:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = moved.where("u <> v")
    return moved.distinct() if smaller else moved


def _finished(edges: DataFrame) -> bool:
    """Whether every node has one link and none links to a node that has one: the graph is stars only."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("links"), F.lit(0).alias("linked")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("links"), F.lit(1).alias("linked"))
    )
    held = ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("linked").alias("linked"))
    return held.where("links > 1 OR links = 1 AND linked = 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a, b), component being the smallest node in reach.

    Null ends and loops are left out. Every step is written to the shared folder, so that a lost
    executor costs a re-read; the loop ends when the graph consists of stars.
    """
    current = stage_narrow(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        name,
    )
    while not _finished(current):
        current = stage_narrow(_relinked(_relinked(current, smaller=False), smaller=True), name)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
