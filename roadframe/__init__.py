"""Street-network and map-feature analytics on Spark DataFrames.

The names below are the usual ones; everything else is in the subpackages.
"""

import logging

from roadframe.model import InsufficientResponseError, Settings, StreetGraph, ValidationError
from roadframe.operators.attributes import add_bearings, add_grades, add_speeds, add_travel_times, project_graph
from roadframe.operators.convert import route_edges, to_digraph, to_undirected, validate_graph
from roadframe.operators.entry import (features_from_address, features_from_bbox, features_from_place, features_from_point, features_from_polygon, features_from_xml,
                                       graph_from_address, graph_from_bbox, graph_from_place, graph_from_point, graph_from_polygon, graph_from_xml)
from roadframe.operators.nearest import nearest_edges, nearest_nodes
from roadframe.operators.paths import largest_component, shortest_paths
from roadframe.operators.simplify import consolidate_intersections, simplify_graph
from roadframe.operators.stats import basic_stats, orientation_entropy
from roadframe.operators.truncate import truncate_bbox, truncate_dist, truncate_polygon
from roadframe.sources.osm import geocode, read_graphml, write_geopackage, write_graphml, write_graphml_parts, write_osm_xml

#: Quiet unless the application gives it a handler.
log = logging.getLogger("roadframe")
log.addHandler(logging.NullHandler())

__all__ = [n for n in dir() if not n.startswith("_") and n != "logging"]
