"""Consolidating pairwise matches into groups (problem 4): connected components by seed-tree pruning.

Each round, every vertex sends the minimum of its closed neighbourhood to all
members of that neighbourhood (selection); a vertex that got minima other than the
smallest links them to the smallest (pruning). A vertex that is the minimum of no
neighbourhood leaves the graph and hangs itself as a leaf under its smallest
minimum in the propagation forest. When no edges are left, the seeds' identifiers
flow down the forest, one round of leavers at a time, from the last to the first.

Both steps are aggregations with map-side combine and joins of a large side with
one row per vertex. Every intermediate is written to the shared folder, so the
lineage stays short, a lost executor costs a task and not a chain, and adaptive
execution can split a hub's partition in any of the joins.

Defined cases: pairs with a null end are ignored; a self-pair makes its vertex a
group of one; direction, repeated pairs and other columns do not matter; an empty
input gives no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframe.session import materialize


def connected_groups(pairs: DataFrame, a: str = "u", b: str = "v", id_column: str = "osmid") -> DataFrame:
    """``(osmid, group_id)``: every vertex of a pair with the smallest vertex linked to it, directly or not."""
    links = pairs.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where(
        "u IS NOT NULL AND v IS NOT NULL")
    graph = materialize(_both_ways(links).distinct(), "graph")
    vertices = None
    left: list[DataFrame] = []
    while vertices is None or not graph.isEmpty():
        minima = materialize(graph.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        if vertices is None:
            vertices = minima.select("u")
        # selection: every neighbour of u, and u itself, hears of u's minimum
        heard = graph.join(minima, "u").select(F.col("v").alias("u"), F.col("m").alias("w"))
        heard = materialize(heard.unionByName(minima.select("u", F.col("m").alias("w"))).distinct(), "heard")
        smallest = materialize(heard.groupBy("u").agg(
            F.min("w").alias("parent"), F.max((F.col("w") == F.col("u")).cast("int")).alias("stays")), "smallest")
        left.append(smallest.where("stays = 0").select("u", "parent"))
        # pruning: what a vertex heard of is linked to the smallest of it
        pruned = heard.join(smallest, "u").where("w <> parent").select(F.col("w").alias("u"), F.col("parent").alias("v"))
        graph = materialize(_both_ways(pruned).distinct(), "graph")
    return _flow_down(vertices, left).select(F.col("u").alias(id_column), "group_id")


def _both_ways(links: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
    return links.select(ends.alias("_e")).select(F.col("_e.a").alias("u"), F.col("_e.b").alias("v"))


def _flow_down(vertices: DataFrame, left: list[DataFrame]) -> DataFrame:
    """Seeds are the vertices that never left; each round of leavers takes its parents' group, last round first."""
    gone = None
    for leavers in left:
        gone = leavers.select("u") if gone is None else gone.unionByName(leavers.select("u"))
    seeds = vertices.join(gone, "u", "left_anti")
    labels = materialize(seeds.select("u", F.col("u").alias("group_id")), "labels")
    for leavers in reversed(left):
        named = leavers.join(labels.withColumnRenamed("u", "parent"), "parent").select("u", "group_id")
        labels = labels.unionByName(materialize(named, "labels"))
    return labels
