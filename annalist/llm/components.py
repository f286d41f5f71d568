"""Connected components of links that are too many for one machine: large-star and small-star in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import with_key_row, written


def _moved(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Each edge's v linked to the least m that was found for its u; a common u's edges stay where they are."""
    out = with_key_row(edges, least, "u", "size", total)
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("size"))
    return _moved(both.where("v > u"), least, total)


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
    return _moved(down, least, total).union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one root, and no root has another."""
    several = edges.groupBy("u").count().where("count > 1")
    chained = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi")
    return several.isEmpty() and chained.isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """node, component: for each node of links (u, v) the least node that it reaches.

    Every round is a written table, so a lost executor costs one round. A node with many links is summed in tasks
    first, and its links stay in the tasks where they are.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        total = edges.count()
        edges = written(_small_star(written(_large_star(edges, total), "links"), total), "links")
        if _are_stars(edges):
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
