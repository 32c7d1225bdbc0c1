"""Connected components of a graph given as an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.frames import ROWS_PER_TASK
from eventloom.session import gathered, materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one edge, to a node that is no ``u`` itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.coalesce(F.max(F.col("up") + F.least("up", "down")), F.lit(0))).first()[0] <= 1


def _written(edges: DataFrame, nodes: int | None) -> DataFrame:
    return materialize(edges if nodes is None else gathered(edges, nodes, ROWS_PER_TASK), "edges")


def star_forest(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """``node, root`` for each node of ``edges (u, v)`` but the roots; ``root`` is the component's smallest node.

    Large stars link each larger neighbour of a node to the smallest one, small stars the smaller ones; a number of
    rounds that grows with the logarithm of the diameter leaves stars only. Minima combine before the shuffle,
    neighbourhoods are never gathered, and each round is written so that a lost executor repeats one round at most.
    ``nodes``, about how many there are, keeps the rounds of a small graph from writing many files.
    """
    stars = _written(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), nodes)
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                            F.struct("u", F.col("m").alias("v")))).alias("e"))
        stars = _written(small.select("e.u", "e.v").where("u <> v").distinct(), nodes)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges (u, v)``, roots included."""
    stars = star_forest(edges)
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
