"""Whole pipelines: street graphs and map features of a polygon, box, point, address or place.

All take an element table and give lazily planned tables, but for the steps that
need rounds (components, chains, distances), which run while the result is built.
A polygon is a list of rings (shell first, then holes) of (lon, lat) points, or a
list of such polygons.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframe.functions.geo import as_parts, inside_parts, require_simple, within_distance
from roadframe.model import EARTH_RADIUS_M, InsufficientResponseError, Settings, StreetGraph
from roadframe.operators import features, nearest, paths, simplify, stats, truncate
from roadframe.operators.build import create_graph, current_nodes, current_ways
from roadframe.session import materialize
from roadframe.sources import osm
from roadframe.sources.tables import current_elements

Polygon = list
BBox = tuple[float, float, float, float]
Tags = dict[str, bool | str | list[str]]
#: Metres around the polygon that are read too, so that streets leading out of it count.
MARGIN_M = 500.0
EVERY_WAY = ['["highway"]', '["highway"!~"."]']


def bbox_to_polygon(bbox: BBox) -> Polygon:
    """A box (left, bottom, right, top) as a polygon."""
    left, bottom, right, top = bbox
    return [[(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)]]


def bbox_around(point: tuple[float, float], dist: float) -> BBox:
    """The box that reaches ``dist`` metres from a point (lat, lon)."""
    lat, lon = point
    up = math.degrees(dist / EARTH_RADIUS_M)
    side = up / math.cos(math.radians(lat))
    return lon - side, lat - up, lon + side, lat + up


def _written(graph: StreetGraph) -> StreetGraph:
    return graph.with_(nodes=materialize(graph.nodes, "nodes"), edges=materialize(graph.edges, "edges"))


def graph_from_polygon(elements: DataFrame, polygon: Polygon, network_type: str = "all", simplified: bool = True, retain_all: bool = False,
                       truncate_by_edge: bool = False, custom_filter: str | list[str] | None = None, settings: Settings = Settings()) -> StreetGraph:
    """The street graph inside a polygon.

    Built from what lies within ``MARGIN_M`` of the polygon, cut to its largest weakly connected component unless
    ``retain_all``, simplified, then cut to the polygon and its largest component again. ``street_count`` of the nodes
    is counted before the last cut, so it holds streets that lead out. With ``truncate_by_edge`` nodes outside stay if a
    neighbour is inside. No node inside: ``InsufficientResponseError``.
    """
    parts = as_parts(polygon)
    require_simple(parts)
    graph = create_graph(elements, network_type, custom_filter, network_type in settings.bidirectional_network_types, settings.all_oneway)
    x, y = F.col("x"), F.col("y")
    wide = _written(truncate.truncate_where(graph, within_distance(x, y, parts, MARGIN_M), truncate_by_edge))
    if wide.nodes.isEmpty():
        raise InsufficientResponseError("no graph node lies within the polygon")
    if not retain_all:
        wide = _written(paths.largest_component(wide))
    if simplified:
        wide = _written(simplify.simplify_graph(wide))
    graph = _written(truncate.truncate_where(wide, inside_parts(x, y, parts), truncate_by_edge))
    if not retain_all:
        graph = _written(paths.largest_component(graph))
    counts = stats.count_streets_per_node(wide.nodes, wide.edges)
    return graph.with_(nodes=graph.nodes.join(counts, "osmid"))


def graph_from_bbox(elements: DataFrame, bbox: BBox, **options) -> StreetGraph:
    """The street graph in a box (left, bottom, right, top); options as for ``graph_from_polygon``."""
    return graph_from_polygon(elements, bbox_to_polygon(bbox), **options)


def graph_from_point(elements: DataFrame, point: tuple[float, float], dist: float, dist_type: str = "bbox", **options) -> StreetGraph:
    """The street graph around a point (lat, lon): in the box that reaches ``dist`` metres, or within that network distance of the nearest node."""
    if dist_type not in ("bbox", "network"):
        raise ValueError("dist_type must be bbox or network")
    graph = graph_from_bbox(elements, bbox_around(point, dist), **options)
    if dist_type == "network":
        spark = elements.sparkSession
        centre = spark.createDataFrame([(0, float(point[1]), float(point[0]))], "point_id bigint, x double, y double")
        node = nearest.nearest_nodes(graph.nodes, centre).first()["osmid"]
        graph = truncate.truncate_dist(graph, node, dist)
    return graph


def graph_from_address(elements: DataFrame, answers: DataFrame, address: str, dist: float, dist_type: str = "bbox", **options) -> StreetGraph:
    """``graph_from_point`` at the place that the saved geocoding ``answers`` give for an address."""
    return graph_from_point(elements, osm.geocode(answers, address), dist, dist_type, **options)


def graph_from_place(elements: DataFrame, answers: DataFrame, query: str | list[str], which_result: int | None = None, **options) -> StreetGraph:
    """``graph_from_polygon`` of the polygons that the saved geocoding ``answers`` give for one or more queries, taken together."""
    return graph_from_polygon(elements, osm.geocode_polygons(answers, query, which_result), **options)


def graph_from_xml(spark: SparkSession, path: str, bidirectional: bool = False, simplified: bool = True, retain_all: bool = False) -> StreetGraph:
    """The street graph of an element XML file: all ways with a highway tag or not, nothing cut, no street counts."""
    graph = create_graph(osm.as_versions(osm.read_osm_xml(spark, path)), custom_filter=EVERY_WAY, bidirectional=bidirectional)
    graph = _written(graph)
    if not retain_all:
        graph = _written(paths.largest_component(graph))
    return simplify.simplify_graph(graph) if simplified else graph


def features_from_polygon(elements: DataFrame, polygon: Polygon | None, tags: Tags) -> DataFrame:
    """``(element, id, tags)`` of nodes, ways and relations that fit any of the tags and share a point with the polygon, in order.

    Without tags, or without a polygon, that test is left out; elements without tags are no features. Features without
    geometry (a missing member or node, a relation of another type) are left out.
    """
    parts = as_parts(polygon) if polygon else None
    if parts:
        require_simple(parts)
    rows = current_elements(elements.where(F.col("type") == "node"), "lat", "lon", "tags").where("visible AND lat IS NOT NULL AND lon IS NOT NULL")
    points = rows.select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "tags")
    relations = current_elements(elements.where(F.col("type") == "relation"), "members", "tags").where("visible")
    ways = materialize(features.way_geometry(current_ways(elements, custom_filter=EVERY_WAY), current_nodes(elements)), "ways")
    return features.features_meeting_polygon(points, ways, relations, parts, tags).orderBy("element", "id")


def features_from_bbox(elements: DataFrame, bbox: BBox, tags: Tags) -> DataFrame:
    return features_from_polygon(elements, bbox_to_polygon(bbox), tags)


def features_from_point(elements: DataFrame, point: tuple[float, float], tags: Tags, dist: float) -> DataFrame:
    return features_from_bbox(elements, bbox_around(point, dist), tags)


def features_from_address(elements: DataFrame, answers: DataFrame, address: str, tags: Tags, dist: float) -> DataFrame:
    return features_from_point(elements, osm.geocode(answers, address), tags, dist)


def features_from_place(elements: DataFrame, answers: DataFrame, query: str | list[str], tags: Tags, which_result: int | None = None) -> DataFrame:
    return features_from_polygon(elements, osm.geocode_polygons(answers, query, which_result), tags)


def features_from_xml(spark: SparkSession, path: str, polygon: Polygon | None = None, tags: Tags | None = None) -> DataFrame:
    return features_from_polygon(osm.as_versions(osm.read_osm_xml(spark, path)), polygon, tags or {})
