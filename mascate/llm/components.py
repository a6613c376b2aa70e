"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mascate.llm.frames import checkpointed
from mascate.operators.lookup import lookup


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    larger = lookup(both.where("v > u"), least, "u", "inner")
    return larger.select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    smaller = lookup(edges, least, "u", "inner")
    ends = F.array("u", "v")
    return smaller.select(F.explode(ends).alias("u"), F.col("least").alias("v")).where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def component_of(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the component's smallest node.

    The rounds grow with the logarithm of the longest path, and rows never outnumber the edges by
    more than a constant. Hubs are split by ``lookup`` and each half round is checkpointed. Only a
    count and a checksum reach the driver. No edges give no rows; loops and repeats do not matter.
    """
    larger, smaller = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = checkpointed(edges.select(larger, smaller).where("u > v").distinct())
    before, state = None, _state(now)
    while state != before:
        now = checkpointed(_small_star(checkpointed(_large_star(now))))
        before, state = state, _state(now)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
