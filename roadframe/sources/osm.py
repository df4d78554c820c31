"""Readers and writers of element files: XML, JSON answers, GraphML; request texts and geocoding answers."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Callable
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from roadframe.functions.geo import parse_wkt_line, wkt_line
from roadframe.model import NODE_TAGS, WAY_TAGS, InsufficientResponseError, ResponseStatusCodeError, Settings, StreetGraph
from roadframe.operators.convert import edge_points, to_undirected
from roadframe.operators.filters import network_filter
from roadframe.session import materialize

_TAG = "tag array<struct<_k:string,_v:string>>"
XML_SCHEMAS = {
    "node": f"_id bigint, _lat double, _lon double, {_TAG}",
    "way": f"_id bigint, nd array<struct<_ref:bigint>>, {_TAG}",
    "relation": f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {_TAG}",
}
ELEMENTS = ("type string, id bigint, lat double, lon double, nodes array<bigint>, "
            "members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>")


def _tag_map(tags: Column) -> Column:
    pairs = F.transform(F.filter(tags, lambda t: t["_k"].isNotNull()), lambda t: F.struct(t["_k"], t["_v"]))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def _xml(spark: SparkSession, row_tag: str) -> DataFrameReader:
    """A reader of one kind of element, which need not stand under a root: the parts of a written file are read too."""
    return spark.read.format("xml").option("rowTag", row_tag).option("useLegacyXMLParser", True)


def read_osm_xml(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a plain, bz2 or gz XML file in the common element columns; untagged elements get an empty map."""
    rows = {k: _xml(spark, k).schema(s).load(path) for k, s in XML_SCHEMAS.items()}
    null = lambda t: F.lit(None).cast(t)
    members = "array<struct<type:string,ref:bigint,role:string>>"
    tags = _tag_map(F.col("tag")).alias("tags")
    node = rows["node"].select(F.lit("node").alias("type"), F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), null("array<bigint>").alias("nodes"), null(members).alias("members"), tags)
    way = rows["way"].select(F.lit("way").alias("type"), F.col("_id").alias("id"), null("double").alias("lat"), null("double").alias("lon"), F.transform("nd", lambda n: n["_ref"]).alias("nodes"), null(members).alias("members"), tags)
    relation = rows["relation"].select(F.lit("relation").alias("type"), F.col("_id").alias("id"), null("double").alias("lat"), null("double").alias("lon"), null("array<bigint>").alias("nodes"),
                                       F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"), tags)
    return node.unionByName(way).unionByName(relation)


def read_osm_json(spark: SparkSession, path: str) -> DataFrame:
    """Elements of saved API answers (whole JSON documents, one per file)."""
    rows = spark.read.schema(f"elements array<struct<{', '.join(c.replace(' ', ':', 1) for c in _columns(ELEMENTS))}>>").json(path, multiLine=True)
    return rows.select(F.explode("elements").alias("e")).select("e.*")


def _columns(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def as_versions(elements: DataFrame) -> DataFrame:
    """Elements without history in the shape of the element table: one current version of each."""
    return elements.withColumns({"version": F.lit(1), "visible": F.lit(True), "ingested_at": F.lit(None).cast("timestamp")})


def _write_parts(path: str, parts: dict[str, DataFrame]) -> None:
    """Text tables into ``path/<name>/part-*``, named so that all parts in order of name are one file."""
    for name, lines in parts.items():
        lines.write.text(f"{path}/{name}")


def _lines(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)


def write_osm_xml(graph: StreetGraph, path: str, node_tags: tuple[str, ...] = NODE_TAGS, way_tags: tuple[str, ...] = WAY_TAGS,
                  way_tag_aggs: dict[str, Callable[[Column], Column]] | None = None) -> None:
    """Nodes and ways of an unsimplified graph as XML parts whose concatenation in order of name is one file.

    One way per ``osmid`` with its nodes in walking order; each tag is that of the way's first edge, or aggregated as
    ``way_tag_aggs`` says. Coordinates have seven decimals; missing tags are left out.
    """
    if graph.attrs.get("simplified"):
        raise ValueError("a simplified graph has no original ways")
    spark = graph.nodes.sparkSession
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), c, F.lit('"'))
    tag = lambda k: F.coalesce(F.concat(F.lit(f'<tag k="{k}" v="'), escape_xml(F.col(k).cast("string")), F.lit('"/>')), F.lit(""))
    fixed = F.lit(' version="1" visible="true" changeset="1" timestamp="1970-01-01T00:00:00Z" user="" uid="1"')
    node = F.concat(F.lit("<node"), attribute("id", F.col("osmid").cast("string")), attribute("lat", F.format_string("%.7f", F.col("y"))), attribute("lon", F.format_string("%.7f", F.col("x"))),
                    fixed, F.lit(">"), *[tag(k) for k in node_tags if k in graph.nodes.columns], F.lit("</node>"))
    tags = [k for k in way_tags if k in graph.edges.columns and not (k == "oneway" and dict(graph.edges.dtypes)[k] == "boolean")]
    forward = graph.edges.where("NOT reversed")
    first = lambda k: F.min_by(k, F.struct("key", "u", "v"))
    one = "oneway" in graph.edges.columns and "oneway" in way_tags and "oneway" not in tags  # a truth value: only "yes" is written
    oneway = F.when(F.col("_one"), F.lit('<tag k="oneway" v="yes"/>')).otherwise("") if one else F.lit("")
    kept = forward.groupBy("osmid").agg(*[((way_tag_aggs or {}).get(k) or first)(k).alias(k) for k in tags], *([F.bool_or("oneway").alias("_one")] if one else [F.lit(False).alias("_one")]))
    refs = F.array_join(F.transform("nodes", lambda n: F.concat(F.lit('<nd ref="'), n.cast("string"), F.lit('"/>'))), "")
    way = F.concat(F.lit("<way"), attribute("id", F.col("osmid").cast("string")), fixed, F.lit(">"), refs, *[tag(k) for k in tags], oneway, F.lit("</way>"))
    ways = way_node_lists(graph.edges).select("osmid", "nodes").join(kept, "osmid")
    _write_parts(path, {"0-head": _lines(spark, '<?xml version="1.0" encoding="UTF-8"?>', '<osm version="0.6" generator="roadframe">'), "1-nodes": graph.nodes.select(node.alias("value")),
                        "2-ways": ways.select(way.alias("value")), "3-foot": _lines(spark, "</osm>")})


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def way_node_lists(edges: DataFrame) -> DataFrame:
    """``(osmid, nodes, highway)``: the nodes of each way in walking order, from its forward edges."""
    import pandas as pd

    forward = edges.where("NOT reversed").select("osmid", "u", "v", "highway")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = chain_nodes(list(zip(pdf["u"].tolist(), pdf["v"].tolist())))
        return pd.DataFrame({"osmid": [pdf["osmid"].iloc[0]], "nodes": [nodes], "highway": [pdf["highway"].iloc[0]]})

    return forward.groupBy("osmid").applyInPandas(order, "osmid bigint, nodes array<bigint>, highway string")


def chain_nodes(pairs: list[tuple[int, int]]) -> list[int]:
    """Nodes along directed steps: from a node that no step enters (any, on a ring), following unused steps."""
    left: dict[int, list[int]] = {}
    for u, v in pairs:
        left.setdefault(u, []).append(v)
    entered = {v for _, v in pairs}
    starts = [u for u, _ in pairs if u not in entered] or [pairs[0][0]]
    path, stack = [], [starts[0]]
    while stack:  # a walk over all steps, with side loops spliced in
        if left.get(stack[-1]):
            stack.append(left[stack[-1]].pop(0))
        else:
            path.append(stack.pop())
    return path[::-1]


#: Types of the usual attributes in GraphML files; others stay text.
NODE_TYPES = {"x": "double", "y": "double", "elevation": "double", "elevation_res": "double", "street_count": "int"}
EDGE_TYPES = {"length": "double", "speed_kph": "double", "travel_time": "double", "grade": "double", "grade_abs": "double", "bearing": "double", "oneway": "boolean", "reversed": "boolean"}
GRAPH_TYPES = {"simplified": "boolean", "consolidated": "boolean"}


def _typed(text: Column, kind: str) -> Column:
    # an edge merged from both kinds holds a list: neither true nor false
    return parse_bool(F.when(~text.rlike(r"^\[.*\]$"), text)) if kind == "boolean" else text if kind == "string" else text.try_cast(kind)


def read_graphml(spark: SparkSession, path: str, node_types: dict[str, str] | None = None, edge_types: dict[str, str] | None = None,
                 graph_types: dict[str, str] | None = None) -> StreetGraph:
    """Graph from a GraphML file or from the parts of one: every declared attribute by its name.

    Types are the given ones, else the usual ones, else text. ``geometry`` is read from its WKT. An edge's key is its
    id where that is a number. Booleans are "True" or "False"; anything else fails.
    """
    data = "data array<struct<_key:string,_VALUE:string>>"
    keys = _xml(spark, "key").schema("`_attr.name` string, _for string, _id string").load(path)
    names = [(r["_for"], r["_attr.name"], r["_id"]) for r in keys.collect()]  # one row per declared attribute

    def columns(kind: str, types: dict[str, str], taken: tuple[str, ...]) -> list[Column]:
        out = []
        for name, key in sorted({(n, k) for of, n, k in names if of == kind and n not in taken}):
            text = F.get(F.filter("data", _with_key(key)), F.lit(0))["_VALUE"]
            out.append((parse_wkt_line(text) if kind == "edge" and name == "geometry" else _typed(text, types.get(name, "string"))).alias(name))
        return out

    node = _xml(spark, "node").schema(f"_id bigint, {data}").load(path)
    nodes = node.select(F.col("_id").alias("osmid"), *columns("node", NODE_TYPES | (node_types or {}), ("osmid",)))
    edge = _xml(spark, "edge").schema(f"_source bigint, _target bigint, _id string, {data}").load(path)
    edges = edge.select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.coalesce(F.col("_id").try_cast("int"), F.lit(0)).alias("key"),
                        *columns("edge", EDGE_TYPES | (edge_types or {}), ("u", "v", "key")))
    attrs: dict[str, Any] = {}
    kinds = GRAPH_TYPES | (graph_types or {})
    for of, name, key in names:
        if of == "graph":
            row = (spark.read.text(path).select(F.regexp_extract("value", rf'<data key="{re.escape(key)}">([^<]*)</data>', 1).alias("v")).where("v <> ''")
                   .select(_typed(F.col("v"), kinds.get(name, "string")).alias("v")).first())
            if row is not None:
                attrs[name] = row["v"]
    crs = str(attrs.get("crs", "epsg:4326")).lower().removeprefix("epsg:")
    return StreetGraph(nodes, edges, {**attrs, "crs": int(crs) if crs.isdigit() else attrs["crs"]})


def _with_key(key: str) -> Callable[[Column], Column]:
    return lambda d: d["_key"] == key


def list_items(text: Column) -> Column:
    """Members of an attribute that holds a list written as text, "[1, 'a']"; any other text is its only member."""
    inner = F.regexp_extract(F.trim(text), r"^\[(.*)\]$", 1)
    items = F.transform(F.split(inner, ","), lambda t: F.regexp_replace(F.trim(t), r"""^['"]|['"]$""", ""))
    return F.when(text.isNull(), F.lit(None)).when(text.rlike(r"^\s*\[.*\]\s*$"), F.filter(items, lambda t: t != "")).otherwise(F.array(text))


def parse_bool(text: Column) -> Column:
    """"True" or "False"; null stays null; anything else fails."""
    return (F.when(text == "True", True).when(text == "False", False).when(text.isNull(), F.lit(None).cast("boolean"))
            .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")))


def _as_text(rows: DataFrame, column: str) -> Column:
    """An attribute as text: booleans as "True" and "False", lines as WKT, lists as "[a, b]" or their only member; empty lists are left out."""
    kind, c = dict(rows.dtypes)[column], F.col(column)
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    if kind == "array<struct<x:double,y:double>>":
        return F.when(F.size(c) >= 2, wkt_line(c))
    if kind.startswith("array"):
        items = (F.transform(c, F.to_json) if "struct" in kind else F.transform(c, lambda b: F.when(b, "True").otherwise("False")) if kind == "array<boolean>" else c.cast("array<string>"))
        return F.when(F.size(c) == 1, F.element_at(items, 1)).when(F.size(c) > 1, F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))
    return F.to_json(F.struct(column)) if kind.startswith(("struct", "map")) else c.cast("string")


def sequential(rows: DataFrame, name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... over all rows, from the sizes of the parts, without bringing the rows together."""
    placed = materialize(rows.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row per part
    starts = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_s"))
    return placed.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_s")


def graphml_lines(graph: StreetGraph, sequential_ids: bool = False) -> DataFrame:
    """GraphML body lines ``(part, value)`` of nodes (0) and edges (1), to go between ``graphml_header`` and its end.

    ``sequential_ids`` numbers the edges, for readers that refuse parallel edges with one id.
    """
    data = lambda k, rows, c: F.coalesce(F.concat(F.lit(f'<data key="{k}">'), escape_xml(_as_text(rows, c)), F.lit("</data>")), F.lit(""))
    n_cols = [c for c in graph.nodes.columns if c != "osmid"]
    e_cols = [c for c in graph.edges.columns if c not in ("u", "v", "key")]
    node = F.concat(F.lit('<node id="'), F.col("osmid").cast("string"), F.lit('">'), *[data(f"n_{c}", graph.nodes, c) for c in n_cols], F.lit("</node>"))
    edges = sequential(graph.edges, "_id") if sequential_ids else graph.edges.withColumn("_id", F.col("key"))
    edge = F.concat(F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('" id="'), F.col("_id").cast("string"), F.lit('">'),
                    *[data(f"e_{c}", graph.edges, c) for c in e_cols], F.lit("</edge>"))
    return graph.nodes.select(F.lit(0).alias("part"), node.alias("value")).unionByName(edges.select(F.lit(1).alias("part"), edge.alias("value")))


def graphml_header(graph: StreetGraph) -> list[str]:
    key = lambda kind, c: f'<key id="{kind[0]}_{c}" for="{kind}" attr.name={quoteattr(c)} attr.type="string"/>'
    keys = [key("node", c) for c in graph.nodes.columns if c != "osmid"] + [key("edge", c) for c in graph.edges.columns if c not in ("u", "v", "key")] + [key("graph", c) for c in graph.attrs]
    text = {**graph.attrs, "crs": f"epsg:{graph.attrs.get('crs', 4326)}"}
    return ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">',
            *[f'<data key="g_{c}">{escape(str(v))}</data>' for c, v in text.items() if c in graph.attrs]]


GRAPHML_END = ["</graph>", "</graphml>"]


def write_graphml_parts(graph: StreetGraph, path: str, sequential_ids: bool = False) -> None:
    """A graph of any size as the parts of one GraphML file, in the order of their names."""
    spark = graph.nodes.sparkSession
    lines = graphml_lines(graph, sequential_ids)
    body = lambda part: lines.where(F.col("part") == part).select("value")
    _write_parts(path, {"0-head": _lines(spark, *graphml_header(graph)), "1-nodes": body(0), "2-edges": body(1), "3-foot": _lines(spark, *GRAPHML_END)})


def write_graphml(graph: StreetGraph, path: str, sequential_ids: bool = False) -> None:
    """One GraphML file on the driver's disk, streamed partition by partition."""
    lines = graphml_lines(graph, sequential_ids)
    with open(path, "w", encoding="utf-8") as file:
        file.writelines(line + "\n" for line in graphml_header(graph))
        for part in (0, 1):
            file.writelines(row["value"] + "\n" for row in lines.where(F.col("part") == part).select("value").toLocalIterator())
        file.writelines(line + "\n" for line in GRAPHML_END)


def write_geopackage(graph: StreetGraph, path: str, directed: bool = False) -> None:
    """Layers ``nodes`` and ``edges`` in one GeoPackage file on the driver's disk, streamed partition by partition.

    Edges are undirected streets unless ``directed``; attributes that are neither numbers nor truth values are text.
    """
    import sqlite3

    edges = edge_points(graph) if directed else to_undirected(graph)
    crs = graph.attrs.get("crs", 4326)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN"}
    head = b"GP\x00\x01" + struct.pack("<i", int(crs))
    point = lambda r: head + struct.pack("<BIdd", 1, 1, r["x"], r["y"])
    line = lambda r: head + struct.pack("<BII", 1, 2, len(r["geometry"])) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in r["geometry"])
    if os.path.exists(path):
        os.remove(path)
    with sqlite3.connect(path) as db:
        db.executescript(f"""PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT CURRENT_TIMESTAMP,
              min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
            INSERT INTO gpkg_spatial_ref_sys VALUES ('undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('undefined geographic', 0, 'NONE', 0, 'undefined', NULL), ('EPSG:{crs}', {crs}, 'EPSG', {crs}, 'undefined', NULL);""")
        for name, rows, shape, geometry in (("nodes", graph.nodes, "POINT", point), ("edges", edges, "LINESTRING", line)):
            columns = [c for c in rows.columns if c != "geometry"]
            types = dict(rows.dtypes)
            db.execute(f"CREATE TABLE {name} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom {shape}, " + ", ".join(f'"{c}" {kinds.get(types[c], "TEXT")}' for c in columns) + ")")
            plain = rows.select(*[F.col(c) if types[c] in kinds else _as_text(rows, c).alias(c) for c in columns], *([] if shape == "POINT" else ["geometry"]))
            values = ([geometry(r), *[r[c] for c in columns]] for r in plain.toLocalIterator())
            db.executemany(f"INSERT INTO {name} (geom, " + ", ".join(f'"{c}"' for c in columns) + ") VALUES (" + ", ".join("?" * (len(columns) + 1)) + ")", values)
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, crs))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (name, shape, crs))


def features_query(place: str, tags: dict[str, bool | str | list[str]], settings: Settings = Settings()) -> str:
    """Request text for features: node, way and relation clauses for each tag condition, recursed down."""
    lines = []
    for key, wanted in tags.items():
        if wanted is not True and not isinstance(wanted, (str, list)):
            raise TypeError("each tag must be true, text or a list of texts")
        values = [None] if wanted is True else [wanted] if isinstance(wanted, str) else list(wanted)
        for value in values:
            clause = f"[{quoteattr(key)}]" if value is None else f"[{quoteattr(key)}={quoteattr(value)}]"
            lines += [f"{kind}{clause}(poly:{place!r});(._;>;);" for kind in ("node", "way", "relation")]
    return request_header(settings) + ";(" + "".join(lines) + ");out;"


def network_query(place: str, network_type: str, settings: Settings = Settings()) -> str:
    return f"{request_header(settings)};(way{network_filter(network_type, settings.default_access)}(poly:{place!r});>;);out;"


def request_header(settings: Settings) -> str:
    size = "" if settings.overpass_memory is None else f"[maxsize:{settings.overpass_memory}]"
    return f"[out:json][timeout:{settings.requests_timeout}]{size}"


def polygon_text(points: Column) -> Column:
    """ "lat lon lat lon ..." with six decimals, as requests want it."""
    return F.array_join(F.transform(points, lambda p: F.format_string("%.6f %.6f", p["y"], p["x"])), " ")


def cache_name(url: str) -> str:
    return hashlib.sha1(url.encode("utf-8")).hexdigest() + ".json"


def cache_key(url: Column) -> Column:
    return F.concat(F.sha1(url.cast("binary")), F.lit(".json"))


def pick_geocode(results: DataFrame, which_result: int | None = None) -> DataFrame:
    """One answer per query from rows ``(query, ord, importance, geom_type, ...)``: the given rank, else the best with an area."""
    order = [F.desc_nulls_last("importance"), "ord"]
    if which_result is not None:
        ranked = results.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
        return ranked.where(F.col("_n") == which_result).drop("_n")
    areas = results.where(F.col("geom_type").isin("Polygon", "MultiPolygon"))
    return areas.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where("_n = 1").drop("_n")


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise InsufficientResponseError(f"no {what} was found")
    return rows


ANSWER = ("array<struct<osm_type:string,osm_id:bigint,lat:string,lon:string,importance:double,display_name:string,boundingbox:array<string>,"
          "geojson:struct<type:string,coordinates:string>>>")


def geocode_answers(saved: DataFrame) -> DataFrame:
    """Rows of saved geocoding answers ``(query, body)``, each body a JSON list: one row per result, numbered by ``ord``.

    ``bbox_west, bbox_south, bbox_east, bbox_north`` come from the answer's (south, north, west, east).
    """
    rows = saved.select("query", F.posexplode(F.from_json("body", ANSWER)).alias("ord", "r"))
    box = lambda i, name: F.get("r.boundingbox", F.lit(i)).try_cast("double").alias(name)
    return rows.select("query", "ord", "r.osm_type", "r.osm_id", F.col("r.lat").try_cast("double").alias("lat"), F.col("r.lon").try_cast("double").alias("lon"),
                       "r.importance", "r.display_name", F.col("r.geojson.type").alias("geom_type"), F.col("r.geojson.coordinates").alias("coordinates"),
                       box(2, "bbox_west"), box(0, "bbox_south"), box(3, "bbox_east"), box(1, "bbox_north"))


def geocode(answers: DataFrame, query: str) -> tuple[float, float]:
    """(lat, lon) of the first result of a query; ``InsufficientResponseError`` without one."""
    row = answers.where((F.col("query") == query) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).orderBy("ord").select("lat", "lon").first()
    if row is None:
        raise InsufficientResponseError(f"nothing was found for {query!r}")
    return row["lat"], row["lon"]


def geocode_places(answers: DataFrame, queries: str | list[str], which_result: int | None = None) -> DataFrame:
    """One result per query, all columns: the given rank by importance (from 1), else the best with an area."""
    wanted = [queries] if isinstance(queries, str) else list(queries)
    return pick_geocode(answers.where(F.col("query").isin(wanted)), which_result)


def geocode_polygons(answers: DataFrame, queries: str | list[str], which_result: int | None = None) -> list:
    """The polygons of all queries' results; a query without an area raises."""
    wanted = [queries] if isinstance(queries, str) else list(queries)
    if not wanted:
        raise InsufficientResponseError("no place was asked for")
    rows = geocode_places(answers, wanted, which_result).select("query", "geom_type", "coordinates").collect()  # one row per query
    found = {r["query"]: r for r in rows}
    parts: list = []
    for query in wanted:
        row = found.get(query)
        if row is None:
            raise InsufficientResponseError(f"no area was found for {query!r}")
        if row["geom_type"] not in ("Polygon", "MultiPolygon"):
            raise TypeError(f"{query!r} is a {row['geom_type']}, not an area")
        shape = json.loads(row["coordinates"])
        parts += [shape] if row["geom_type"] == "Polygon" else shape
    return [[[(float(x), float(y)) for x, y, *_ in ring] for ring in part] for part in parts]


def read_cached_answers(spark: SparkSession, folder: str, url: str) -> DataFrame:
    """Elements of the answer saved for a request address; a failing answer raises ``ResponseStatusCodeError``."""
    path = f"{folder}/{cache_name(url)}"
    remark = spark.read.schema("remark string, error string").json(path, multiLine=True).first()
    if remark is None:
        raise InsufficientResponseError(f"no answer is saved for {url!r}")
    if remark["error"] is not None:
        raise ResponseStatusCodeError(remark["error"])
    return read_osm_json(spark, path)
