"""Connected components of a table of links, by alternating star steps that never gather a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laptable.llm.common import cut_lineage, few_tasks


def _star(edges: DataFrame) -> DataFrame:
    """Links every node's neighbours above it, and the node itself, to the smallest of its neighbourhood (rows may repeat)."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return larger.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v")


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """``u > v`` in all edges: links the smaller neighbours of every node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return few_tasks(smaller.unionByName(least.select("u", F.col("m").alias("v"))), rows).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``links`` (u, v) but the smallest ones.

    Each round is stored. Rounds grow with the logarithm of the longest path; groups are only ever reduced to a minimum.
    Every step takes as many tasks as the counted edges are worth: few edges in many tasks would write mostly empty files.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = cut_lineage(edges), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return few_tasks(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), now[0])
        before = now
        # A star step gives at most one row per edge and one per node.
        edges, most = few_tasks(edges, now[0]), 3 * now[0]
        edges = cut_lineage(few_tasks(_small_star(few_tasks(_star(edges), most), most), most))
