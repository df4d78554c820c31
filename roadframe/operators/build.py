"""From elements to a directed street graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadframe.functions.geo import great_circle
from roadframe.model import NODE_TAGS, WAY_TAGS, StreetGraph
from roadframe.operators.filters import way_predicate
from roadframe.sources.tables import current_elements

_ONEWAY = ("yes", "true", "1", "-1", "reverse", "T", "F")
_REVERSED = ("-1", "reverse", "T")


def current_nodes(elements: DataFrame) -> DataFrame:
    """``(osmid, x, y, <node tags>)`` of undeleted node elements with both coordinates."""
    rows = elements.where(F.col("type") == "node").select("type", "id", "version", "ingested_at", "visible", "lat", "lon", *[F.col("tags")[t].alias(t) for t in NODE_TAGS])
    return current_elements(rows, "lat", "lon", *NODE_TAGS).where("visible AND lat IS NOT NULL AND lon IS NOT NULL").select(
        F.col("id").alias("osmid"), F.col("lon").alias("x"), F.col("lat").alias("y"), *NODE_TAGS)


def current_ways(elements: DataFrame, network_type: str = "all", custom_filter: str | list[str] | None = None) -> DataFrame:
    """``(osmid, nodes, tags)`` of undeleted ways that pass the filter; refs repeated in a row are collapsed."""
    rows = current_elements(elements.where(F.col("type") == "way"), "nodes", "tags").where("visible AND nodes IS NOT NULL")
    kept = rows.where(way_predicate(network_type, custom_filter))
    refs = F.filter("nodes", lambda n: n.isNotNull())
    collapsed = F.filter(refs, lambda n, i: (i == 0) | (n != F.get(refs, i - 1)))
    return kept.select(F.col("id").alias("osmid"), collapsed.alias("nodes"), "tags")


def oneway_rule(tags: str = "tags", bidirectional: bool = False, all_oneway: bool = False) -> Column:
    """Ordered rules: everything one-way; network walked both ways; a one-way tag value; a roundabout."""
    if all_oneway:
        return F.lit(True)
    if bidirectional:
        return F.lit(False)
    return F.coalesce(F.col(tags)["oneway"].isin(*_ONEWAY), F.lit(False)) | F.coalesce(F.col(tags)["junction"] == "roundabout", F.lit(False))


def reversed_rule(tags: str = "tags") -> Column:
    return F.coalesce(F.col(tags)["oneway"].isin(*_REVERSED), F.lit(False))


def way_segments(ways: DataFrame, bidirectional: bool = False, all_oneway: bool = False) -> DataFrame:
    """``(way, seq, u, v, oneway, reversed, tags)``: one row per directed edge, before lengths and keys.

    A two-way street gives both directions; the backward one has ``reversed`` true.
    """
    one = oneway_rule(bidirectional=bidirectional, all_oneway=all_oneway)
    rows = ways.select("osmid", "tags", one.alias("oneway"), F.when(one & reversed_rule(), F.reverse("nodes")).otherwise(F.col("nodes")).alias("nodes"))
    rows = rows.where(F.size("nodes") >= 2)
    heads = F.slice("nodes", 1, F.size("nodes") - 1)
    legs = F.zip_with(heads, F.slice("nodes", 2, F.size("nodes") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    legs = rows.select("osmid", "tags", "oneway", F.posexplode(legs).alias("seq", "leg"))
    ways_of = F.when(F.col("oneway"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    both = legs.withColumn("reversed", F.explode(ways_of))
    return both.select(F.col("osmid").alias("way"), "seq", F.when(F.col("reversed"), F.col("leg.b")).otherwise(F.col("leg.a")).alias("u"),
                       F.when(F.col("reversed"), F.col("leg.a")).otherwise(F.col("leg.b")).alias("v"), "oneway", "reversed", "tags")


def with_keys(edges: DataFrame, *order: str) -> DataFrame:
    """Add ``key``: 0, 1, ... among parallel edges in the given order."""
    return edges.withColumn("key", (F.row_number().over(Window.partitionBy("u", "v").orderBy(*order)) - 1).cast("int"))


def with_endpoints(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Add ``u_<c>`` and ``v_<c>`` of both end nodes; edges without both ends are dropped."""
    pick = lambda p: nodes.select(F.col("osmid").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return edges.join(pick("u"), "u").join(pick("v"), "v")


def add_edge_lengths(edges: DataFrame, nodes: DataFrame, on_missing: str = "drop") -> DataFrame:
    """Great-circle length of the straight line between the ends.

    ``on_missing``: "drop" leaves out edges whose end has no coordinates; "error" makes the query fail on the first one.
    """
    if on_missing == "error":
        pick = lambda p: nodes.select(F.col("osmid").alias(p), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"))
        joined = edges.join(pick("u"), "u", "left").join(pick("v"), "v", "left")
        length = great_circle(F.col("u_y"), F.col("u_x"), F.col("v_y"), F.col("v_x"))
        return joined.withColumn("length", F.coalesce(length, F.raise_error(F.lit("an edge's end has no coordinates")).cast("double"))).drop("u_x", "u_y", "v_x", "v_y")
    joined = with_endpoints(edges, nodes, "x", "y")
    return joined.withColumn("length", great_circle(F.col("u_y"), F.col("u_x"), F.col("v_y"), F.col("v_x"))).drop("u_x", "u_y", "v_x", "v_y")


def create_graph(elements: DataFrame, network_type: str = "all", custom_filter: str | list[str] | None = None, bidirectional: bool | None = None,
                 all_oneway: bool = False) -> StreetGraph:
    """Nodes and directed edges with keys, lengths and the useful way tags."""
    nodes = current_nodes(elements)
    both = network_type == "walk" if bidirectional is None else bidirectional
    ways = current_ways(elements, network_type, custom_filter)
    segments = with_keys(way_segments(ways, both, all_oneway), "way", "reversed", "seq")
    edges = add_edge_lengths(segments, nodes).select("u", "v", "key", F.col("way").alias("osmid"), "length", "oneway", "reversed",
                                                     *[F.col("tags")[t].alias(t) for t in WAY_TAGS if t not in ("oneway",)])
    used = ways.select(F.explode("nodes").alias("osmid")).distinct()  # also nodes that no edge leads to
    return StreetGraph(nodes.join(used, "osmid", "left_semi"), edges, {"crs": 4326, "simplified": False})
