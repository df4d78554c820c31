"""Cutting a graph by place or by network distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframe.functions.geo import inside_polygon
from roadframe.model import StreetGraph
from roadframe.operators.paths import distances_from


def keep_nodes(graph: StreetGraph, kept: DataFrame) -> StreetGraph:
    """The subgraph of the given nodes; an edge stays when both its ends do."""
    ids = kept.select("osmid")
    edges = graph.edges.join(ids.withColumnRenamed("osmid", "u"), "u", "left_semi").join(ids.withColumnRenamed("osmid", "v"), "v", "left_semi")
    return graph.with_(nodes=graph.nodes.join(ids, "osmid", "left_semi"), edges=edges.select(*graph.edges.columns))


def truncate_where(graph: StreetGraph, inside: Column, by_edge: bool) -> StreetGraph:
    """Nodes for which ``inside`` holds; with ``by_edge`` also their neighbours."""
    kept = graph.nodes.where(inside).select("osmid")
    if by_edge:  # also the outer ends of edges that start or end inside
        links = graph.edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("_e")).select("_e.a", "_e.b")
        near = links.join(kept.withColumnRenamed("osmid", "a"), "a", "left_semi").select(F.col("b").alias("osmid"))
        kept = kept.unionByName(near).distinct()
    return keep_nodes(graph, kept)


def truncate_bbox(graph: StreetGraph, bbox: tuple[float, float, float, float], by_edge: bool = False) -> StreetGraph:
    """Nodes in the closed box (left, bottom, right, top); the box reaches the scan as a pushed filter."""
    left, bottom, right, top = bbox
    return truncate_where(graph, F.col("x").between(left, right) & F.col("y").between(bottom, top), by_edge)


def truncate_polygon(graph: StreetGraph, polygon: list[list[tuple[float, float]]], by_edge: bool = False) -> StreetGraph:
    """Nodes in or on a polygon (shell first, then holes)."""
    return truncate_where(graph, inside_polygon(F.col("x"), F.col("y"), polygon), by_edge)


def truncate_dist(graph: StreetGraph, source: int, dist: float, weight: str = "length") -> StreetGraph:
    """Nodes reachable from ``source`` along edges within ``dist``; an isochrone when the weight is a travel time."""
    reached = distances_from(graph.edges, source, weight, dist)
    return keep_nodes(graph, reached)
