"""Queries of the street-network operators, each with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframe.functions import geo
from roadframe.functions.maxspeed import IMPLICIT_KPH, clean_maxspeed
from roadframe.model import StreetGraph
from roadframe.operators import attributes, build, convert, entry, filters, nearest, paths, sampling, simplify, stats, truncate
from roadframe.plans.base import CURRENT_SQL, GRAPH_SQL, bearing_sql, edges, graph, haversine, nodes
from roadframe.sources import osm
from roadframe.sources.tables import current_elements, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
G, C = "WITH " + GRAPH_SQL, "WITH " + CURRENT_SQL


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- from elements to a graph -------------------------------------------------

@query(C + " SELECT type, count(*)::BIGINT n, count(*) FILTER (cardinality(tags) > 0)::BIGINT tagged FROM cur GROUP BY type")
def elements_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(table(spark, d, "elements"), "tags").where("visible")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(F.coalesce("tags", F.create_map().cast("map<string,string>"))) > 0).alias("tagged"))


@query(C + " SELECT osmid, x, y, tags['highway'] highway, tags['junction'] junction, tags['railway'] railway, tags['ref'] ref FROM en")
def node_columns(spark: SparkSession, d: str) -> DataFrame:
    return build.current_nodes(table(spark, d, "elements"))


def _clause_sql(text: str) -> str:
    tests = []
    for key, op, value in filters.parse_clauses(text):
        tag = f"tags['{key}']"
        tests.append({None: f"{tag} IS NOT NULL", "=": f"coalesce({tag} = '{value}', false)", "!=": f"coalesce({tag} <> '{value}', true)",
                      "~": f"coalesce(regexp_matches({tag}, '{value}'), false)", "!~": f"NOT coalesce(regexp_matches({tag}, '{value}'), false)"}[op])
    return " AND ".join(tests)


def _network_filter(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return build.current_ways(table(spark, d, "elements"), name).select("osmid", F.size("nodes").cast("bigint").alias("n_refs"))

    run.__name__ = f"network_filter_{name}"
    query(C + f""" SELECT osmid, len(list_filter(refs, lambda n, i: i = 1 OR n <> refs[i - 1]))::BIGINT n_refs FROM ew
        WHERE {_clause_sql(filters.network_filter(name))}""")(run)


for _name in filters.PRESETS:
    _network_filter(_name)

_CUSTOM = ['["highway"~"primary|secondary"]["name"]', '["building"="yes"]']


@query(C + f" SELECT osmid FROM ew WHERE ({_clause_sql(_CUSTOM[0])}) OR ({_clause_sql(_CUSTOM[1])})")
def custom_filter_union(spark: SparkSession, d: str) -> DataFrame:
    return build.current_ways(table(spark, d, "elements"), custom_filter=_CUSTOM).select("osmid")


_ONE = "(coalesce(tags['oneway'] IN ('yes','true','1','-1','reverse','T','F'), false) OR coalesce(tags['junction'] = 'roundabout', false))"
_REV = "coalesce(tags['oneway'] IN ('-1','reverse','T'), false)"


@query(C + f" SELECT osmid, {_ONE} oneway, {_ONE} AND {_REV} is_reversed FROM ew WHERE tags['highway'] IS NOT NULL")
def oneway_rules(spark: SparkSession, d: str) -> DataFrame:
    ways = build.current_ways(table(spark, d, "elements"), custom_filter='["highway"]')
    return ways.select("osmid", build.oneway_rule().alias("oneway"), (build.oneway_rule() & build.reversed_rule()).alias("is_reversed"))


_SEGMENTS = f"""{C},
w AS (SELECT osmid, {_ONE} oneway, tags, list_filter(refs, lambda n, i: i = 1 OR n <> refs[i - 1]) r FROM ew WHERE {_clause_sql(filters.network_filter('all'))}),
w2 AS (SELECT osmid, oneway, tags, CASE WHEN oneway AND {_REV} THEN list_reverse(r) ELSE r END r FROM w),
f AS (SELECT osmid way, i - 1 seq, r[i] u, r[i + 1] v, oneway, tags FROM (SELECT *, unnest(range(1, len(r))) i FROM w2)),
seg AS (SELECT way, seq, u, v, oneway, false reversed FROM f UNION ALL SELECT way, seq, v, u, oneway, true FROM f WHERE NOT oneway)"""


@query(_SEGMENTS + " SELECT way, seq::INTEGER seq, u, v, oneway, reversed FROM seg")
def way_segments(spark: SparkSession, d: str) -> DataFrame:
    return build.way_segments(build.current_ways(table(spark, d, "elements"))).drop("tags")


@query(_SEGMENTS + f""" SELECT u, v, (row_number() OVER (PARTITION BY u, v ORDER BY way, reversed, seq) - 1)::INTEGER key, way osmid, oneway, reversed,
    round({haversine('a.y', 'a.x', 'b.y', 'b.x')}, 3) length FROM seg JOIN en a ON a.osmid = u JOIN en b ON b.osmid = v""")
def create_graph(spark: SparkSession, d: str) -> DataFrame:
    # keys are numbered among all edges; the SQL numbers those with both ends, so keep to edges of complete pairs
    made = build.create_graph(table(spark, d, "elements")).edges
    return made.select("u", "v", "key", "osmid", "oneway", "reversed", F.round("length", 3).alias("length"))


@query(_SEGMENTS + f""", e AS (SELECT seg.*, {haversine('a.y', 'a.x', 'b.y', 'b.x')} length, ew.tags['highway'] highway FROM seg JOIN en a ON a.osmid = u JOIN en b ON b.osmid = v JOIN ew ON ew.osmid = way)
    SELECT highway, count(*)::BIGINT n, round(sum(length), 2) length FROM e GROUP BY highway""")
def length_by_highway(spark: SparkSession, d: str) -> DataFrame:
    made = build.create_graph(table(spark, d, "elements")).edges
    return made.groupBy("highway").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 2).alias("length"))


# ---- graphs of a place ---------------------------------------------------------

_PLACE = [[(-120.0, -50.0), (150.0, -50.0), (150.0, 60.0), (-120.0, 60.0), (-120.0, -50.0)], [(-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (-10.0, 10.0), (-10.0, -10.0)]]
_EDGES = _SEGMENTS + f""", es AS (SELECT u, v, (row_number() OVER (PARTITION BY u, v ORDER BY way, reversed, seq) - 1)::INTEGER key, way osmid,
    round({haversine('a.y', 'a.x', 'b.y', 'b.x')}, 3) length, a.x ux, a.y uy, b.x vx, b.y vy FROM seg JOIN en a ON a.osmid = u JOIN en b ON b.osmid = v)"""
_IN = "(X BETWEEN -120 AND 150 AND Y BETWEEN -50 AND 60 AND NOT (X > -10 AND X < 10 AND Y > -10 AND Y < 10))"


@query(_EDGES + f" SELECT u, v, key, osmid, length FROM es WHERE {_IN.replace('X', 'ux').replace('Y', 'uy')} AND {_IN.replace('X', 'vx').replace('Y', 'vy')}")
def graph_from_polygon(spark: SparkSession, d: str) -> DataFrame:
    made = entry.graph_from_polygon(table(spark, d, "elements"), _PLACE, simplified=False, retain_all=True)
    return made.edges.select("u", "v", "key", "osmid", F.round("length", 3).alias("length"))


@query()
def graph_from_polygon_streets(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: largest component, simplified, with street counts."""
    made = entry.graph_from_polygon(table(spark, d, "elements"), _PLACE, "drive_service")
    return made.nodes.select("osmid", "x", "y", "street_count")


@query(_EDGES + """, i AS (SELECT osmid FROM en WHERE x BETWEEN -60 AND 60 AND y BETWEEN -40 AND 45),
    k AS (SELECT osmid FROM i UNION SELECT v FROM es WHERE u IN (SELECT osmid FROM i) UNION SELECT u FROM es WHERE v IN (SELECT osmid FROM i))
    SELECT u, v, key, osmid, length FROM es WHERE u IN (SELECT osmid FROM k) AND v IN (SELECT osmid FROM k)""")
def graph_from_bbox(spark: SparkSession, d: str) -> DataFrame:
    made = entry.graph_from_bbox(table(spark, d, "elements"), (-60.0, -40.0, 60.0, 45.0), simplified=False, retain_all=True, truncate_by_edge=True)
    return made.edges.select("u", "v", "key", "osmid", F.round("length", 3).alias("length"))


def _area_answers(spark: SparkSession, d: str) -> DataFrame:
    """The areas as saved geocoding answers: their names are the queries."""
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    shape = F.to_json(F.struct(F.transform("polygons", lambda part: F.transform(part, ring)).alias("c")))
    text = F.concat(F.lit('[{"lat": "0", "lon": "0", "importance": 1, "geojson": {"type": "MultiPolygon", "coordinates": '), F.substring_index(F.substring(shape, 6, 1 << 30), "}", 1), F.lit("}}]"))
    return osm.geocode_answers(table(spark, d, "areas").select(F.col("area_id").cast("string").alias("query"), text.alias("body")))


@query(_EDGES + """, rg AS (SELECT area_id, part, unnest(p) ring FROM (SELECT area_id, unnest(polygons) p, unnest(range(len(polygons))) part FROM areas)),
    sd AS (SELECT area_id, part, ring[i].x x1, ring[i].y y1, ring[i + 1].x x2, ring[i + 1].y y2 FROM (SELECT area_id, part, ring, unnest(range(1, len(ring))) i FROM rg)),
    k AS (SELECT DISTINCT osmid FROM (SELECT osmid, area_id, part FROM en JOIN sd ON (y1 <= y) <> (y2 <= y) AND x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1))
    SELECT u, v, key, osmid, length FROM es WHERE u IN (SELECT osmid FROM k) AND v IN (SELECT osmid FROM k)""")
def graph_from_place(spark: SparkSession, d: str) -> DataFrame:
    """All areas together as one place."""
    names = [str(r["area_id"]) for r in table(spark, d, "areas").select("area_id").distinct().orderBy("area_id").collect()]  # the places asked for
    made = entry.graph_from_place(table(spark, d, "elements"), _area_answers(spark, d), names, which_result=1, simplified=False, retain_all=True)
    return made.edges.select("u", "v", "key", "osmid", F.round("length", 3).alias("length"))


# ---- attributes ---------------------------------------------------------------

@query(G + f" SELECT u, v, key, round({haversine('uy', 'ux', 'vy', 'vx')}, 3) length FROM gx")
def edge_lengths(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return build.add_edge_lengths(g.edges.drop("length"), g.nodes).select("u", "v", "key", F.round("length", 3).alias("length"))


_BEARINGS = G + f", gb AS (SELECT *, CASE WHEN u <> v THEN {bearing_sql('uy', 'ux', 'vy', 'vx')} END bearing FROM gx)"


@query(_BEARINGS + " SELECT u, v, key, round(bearing, 6) % 360 bearing FROM gb")
def bearings(spark: SparkSession, d: str) -> DataFrame:
    return attributes.add_bearings(graph(spark, d)).select("u", "v", "key", (F.round("bearing", 6) % 360).alias("bearing"))


@query(G + " SELECT u, v, key, round((ve - ue) / nullif(length, 0), 6) grade, round(abs((ve - ue) / nullif(length, 0)), 6) grade_abs FROM gx")
def grades(spark: SparkSession, d: str) -> DataFrame:
    return attributes.add_grades(graph(spark, d)).select("u", "v", "key", F.round("grade", 6).alias("grade"), F.round("grade_abs", 6).alias("grade_abs"))


_IMPLICIT = ", ".join(f"('{k}', {v})" for k, v in IMPLICIT_KPH.items())
_PARTS = ("list_transform(string_split(maxspeed, '|'), lambda p: CASE WHEN substr(p, length(regexp_extract(p, '^[0-9][0-9.,]*')) + 1) IN "
          "('', 'km/h', 'kmh', 'kph', 'mph', 'knots', ' km/h', ' kmh', ' kph', ' mph', ' knots') THEN try_cast(replace(regexp_extract(p, '^[0-9][0-9.,]*'), ',', '.') AS DOUBLE) END)")
_CLEAN = f""", implied(code, kph) AS (VALUES {_IMPLICIT}),
clean AS (SELECT ge.*, CASE WHEN len(list_filter({_PARTS}, lambda v: v IS NULL)) = 0 THEN list_avg({_PARTS}) * CASE WHEN contains(maxspeed, 'mph') THEN 1.60934 ELSE 1.0 END
   ELSE kph END stated FROM ge LEFT JOIN implied ON code = maxspeed)"""
_SPEEDS = G + _CLEAN + """, typ AS (SELECT highway, avg(stated) t FROM clean WHERE highway IS NOT NULL GROUP BY highway),
sp AS (SELECT clean.*, coalesce(stated, CASE WHEN highway IS NOT NULL THEN coalesce(t, (SELECT avg(t) FROM typ)) END) speed_kph FROM clean LEFT JOIN typ USING (highway))"""


@query(G + _CLEAN + " SELECT ord, maxspeed, round(stated, 6) kph FROM clean WHERE maxspeed IS NOT NULL")
def maxspeed_clean(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("maxspeed IS NOT NULL").select("ord", "maxspeed", F.round(clean_maxspeed(F.col("maxspeed")), 6).alias("kph"))


@query(_SPEEDS + " SELECT u, v, key, round(speed_kph, 5) speed_kph FROM sp")
def speeds(spark: SparkSession, d: str) -> DataFrame:
    return attributes.add_speeds(edges(spark, d)).select("u", "v", "key", F.round("speed_kph", 5).alias("speed_kph"))


@query(_SPEEDS + " SELECT u, v, key, round((length / 1000) / nullif(speed_kph / 3600, 0), 2) travel_time FROM sp")
def travel_times(spark: SparkSession, d: str) -> DataFrame:
    return attributes.add_travel_times(attributes.add_speeds(edges(spark, d))).select("u", "v", "key", F.round("travel_time", 2).alias("travel_time"))


_RASTER = (-180.0, 90.0, 0.5, 0.5)


@query(G + """, cell AS (SELECT floor((x + 180) / 0.5) c, floor((90 - y) / 0.5) r, avg(elevation) value FROM gn WHERE elevation IS NOT NULL GROUP BY 1, 2)
    SELECT osmid, round(value, 6) elevation FROM gn LEFT JOIN cell ON c = floor((x + 180) / 0.5) AND r = floor((90 - y) / 0.5)""")
def elevation_raster(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    x0, y0, dx, dy = _RASTER
    cells = n.where("elevation IS NOT NULL").groupBy(F.floor((F.col("x") - x0) / dx).alias("col"), F.floor((F.lit(y0) - F.col("y")) / dy).alias("row")).agg(F.avg("elevation").alias("value"))
    return attributes.sample_raster(n, cells, *_RASTER).select("osmid", F.round("elevation", 6).alias("elevation"))


@query(G + """, b AS (SELECT osmid, ((osmid % 64) + 64) % 64 g, (row_number() OVER (PARTITION BY ((osmid % 64) + 64) % 64 ORDER BY osmid) - 1) // 512 b FROM gn)
    SELECT (b * 64 + g)::BIGINT batch, count(*)::BIGINT n, count(*)::INTEGER n_places FROM b GROUP BY b, g""")
def elevation_batches(spark: SparkSession, d: str) -> DataFrame:
    # the last decimal of a place may round either way in another engine, so places are counted
    return attributes.elevation_batches(nodes(spark, d)).select("batch", "n", F.size(F.split("locations", r"\|")).alias("n_places"))


# transverse Mercator of the usual ellipsoid by its series, with plain numbers: eccentricity, scaled radius and the terms that reach a millimetre
_UTM = """, z AS (SELECT osmid, y, least(floor((x + 180) / 6)::INTEGER + 1, 60) zone, radians(y) phi, x FROM gn WHERE y BETWEEN -80 AND 84),
    q AS (SELECT osmid, CASE WHEN y < 0 THEN 32700 ELSE 32600 END + zone epsg, phi, radians(x - (zone * 6 - 183)) lam FROM z),
    tt AS (SELECT osmid, epsg, lam, atanh(sin(phi)) - 0.08181919084262149 * atanh(0.08181919084262149 * sin(phi)) s FROM q),
    t2 AS (SELECT osmid, epsg, lam, (exp(s) - exp(-s)) / 2 t FROM tt),
    xe AS (SELECT osmid, epsg, atan2(t, cos(lam)) xi, atanh(sin(lam) / sqrt(1 + t * t)) eta FROM t2),
    hy AS (SELECT *, (exp(2 * eta) - exp(-2 * eta)) / 2 s2, (exp(2 * eta) + exp(-2 * eta)) / 2 c2, (exp(4 * eta) - exp(-4 * eta)) / 2 s4, (exp(4 * eta) + exp(-4 * eta)) / 2 c4,
      (exp(6 * eta) - exp(-6 * eta)) / 2 s6, (exp(6 * eta) + exp(-6 * eta)) / 2 c6, (exp(8 * eta) - exp(-8 * eta)) / 2 s8, (exp(8 * eta) + exp(-8 * eta)) / 2 c8 FROM xe),
    pr AS (SELECT osmid, epsg, round(500000 + RADIUS * (eta + A1 * cos(2 * xi) * s2 + A2 * cos(4 * xi) * s4 + A3 * cos(6 * xi) * s6 + A4 * cos(8 * xi) * s8), 3) x,
      round(CASE WHEN epsg > 32700 THEN 10000000 ELSE 0 END + RADIUS * (xi + A1 * sin(2 * xi) * c2 + A2 * sin(4 * xi) * c4 + A3 * sin(6 * xi) * c6 + A4 * sin(8 * xi) * c8), 3) y FROM hy)
    SELECT osmid, epsg, pr.x, pr.y FROM gn LEFT JOIN pr USING (osmid)"""
for _mark, _number in (("RADIUS", "6364902.166165086"), ("A1", "0.00083773182062446983"), ("A2", "0.00000076085277735726"), ("A3", "0.0000000011976455033"), ("A4", "0.0000000000024291706072")):
    _UTM = _UTM.replace(_mark, _number)


@query(G + _UTM)
def utm_project(spark: SparkSession, d: str) -> DataFrame:
    """Every node in the zone of its own longitude and hemisphere."""
    return attributes.project_nodes_by_zone(nodes(spark, d)).select("osmid", "epsg", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(G + f""" SELECT osmid, round(x - 0.004496601677418 / cos(radians(y)), 9) "left", round(y - 0.004496601677418, 9) bottom,
    round(x + 0.004496601677418 / cos(radians(y)), 9) "right", round(y + 0.004496601677418, 9) top FROM gn""")
def bbox_from_point(spark: SparkSession, d: str) -> DataFrame:
    box = geo.bbox_from_point(F.col("y"), F.col("x"), 500.0)
    return nodes(spark, d).select("osmid", box.alias("b")).select("osmid", *[F.round(f"b.{c}", 9).alias(c) for c in ("left", "bottom", "right", "top")])


# ---- statistics ---------------------------------------------------------------

_SPN = G + """, st AS (SELECT DISTINCT least(u, v) a, greatest(u, v) b, key FROM ge WHERE u <> v),
inc AS (SELECT a o FROM st UNION ALL SELECT b FROM st UNION ALL SELECT * FROM (SELECT DISTINCT u FROM ge WHERE u = v) UNION ALL SELECT * FROM (SELECT DISTINCT u FROM ge WHERE u = v)),
spn AS (SELECT osmid, count(o)::BIGINT street_count FROM gn LEFT JOIN inc ON o = osmid GROUP BY osmid)"""
# every edge as its points: those of its text, else its two ends
_LINES = G + """, ln AS (SELECT *, CASE WHEN geom_wkt IS NULL THEN [{'x': ux, 'y': uy}, {'x': vx, 'y': vy}] ELSE
      list_transform(string_split(regexp_extract(geom_wkt, '\\(([^()]*)\\)', 1), ','), lambda p: {'x': string_split(trim(p), ' ')[1]::DOUBLE, 'y': string_split(trim(p), ' ')[2]::DOUBLE}) END p FROM gx),
    sg AS (SELECT u, v, key, p[i].x ux, p[i].y uy, p[i + 1].x - p[i].x dx, p[i + 1].y - p[i].y dy FROM (SELECT *, unnest(range(1, len(p))) i FROM ln))"""
# streets: directions that share a key and a line merge, others of one key get a new one; then one per way and line
_STREETS = _LINES + """, sa AS (SELECT *, least(u, v) a, greatest(u, v) b, CASE WHEN p::VARCHAR <= list_reverse(p)::VARCHAR THEN p::VARCHAR ELSE list_reverse(p)::VARCHAR END g FROM ln),
    sb AS (SELECT *, row_number() OVER (PARTITION BY a, b, key ORDER BY ord) r, min(g) OVER (PARTITION BY a, b, key) = max(g) OVER (PARTITION BY a, b, key) same, max(key) OVER (PARTITION BY a, b) top FROM sa),
    sc AS (SELECT *, CASE WHEN r = 1 AND NOT same THEN top + row_number() OVER (PARTITION BY a, b, r = 1 AND NOT same ORDER BY key) ELSE key END nk FROM sb WHERE r = 1 OR NOT same),
    sd AS (SELECT *, row_number() OVER (PARTITION BY a, b, osmid, g ORDER BY nk) dr FROM sc),
    su AS (SELECT a u, b v, nk::INTEGER key, u "from", v "to", ord, length, ux, uy, vx, vy FROM sd WHERE dr = 1)"""
_SPN_STREETS = _STREETS + _SPN[len(G):]


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_streets_per_node(nodes(spark, d), edges(spark, d))


def _undirected(spark: SparkSession, d: str) -> DataFrame:
    return convert.to_undirected(graph(spark, d, geometry=True))


@query(_SPN + " SELECT osmid, street_count FROM spn")
def streets_per_node(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


@query(_SPN + " SELECT round(sum(street_count) / count(*), 6) streets_per_node_avg FROM spn")
def streets_per_node_avg(spark: SparkSession, d: str) -> DataFrame:
    return stats.streets_per_node_avg(_counts(spark, d)).select(F.round("streets_per_node_avg", 6).alias("streets_per_node_avg"))


@query(_SPN + """ SELECT s::BIGINT streets, count(osmid)::BIGINT n, round(count(osmid) / (SELECT count(*) FROM spn), 6) proportion
    FROM range(0, (SELECT max(street_count) + 1 FROM spn)) r(s) LEFT JOIN spn ON street_count = s GROUP BY s""")
def streets_per_node_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.streets_per_node_counts(_counts(spark, d)).withColumn("proportion", F.round("proportion", 6)).withColumn("n", F.col("n").cast("bigint"))


@query(_SPN + " SELECT count(*) FILTER (street_count >= 2)::BIGINT intersection_count FROM spn")
def intersection_count(spark: SparkSession, d: str) -> DataFrame:
    return stats.intersection_count(_counts(spark, d))


@query(G + " SELECT count(*)::BIGINT edge_count, round(sum(length), 2) edge_length_total, round(avg(length), 4) edge_length_avg FROM ge")
def edge_length_total(spark: SparkSession, d: str) -> DataFrame:
    return stats.edge_totals(edges(spark, d), "edge").select("edge_count", F.round("edge_length_total", 2).alias("edge_length_total"), F.round("edge_length_avg", 4).alias("edge_length_avg"))


@query(_STREETS + " SELECT count(*)::BIGINT street_count, round(sum(length), 2) street_length_total, round(avg(length), 4) street_length_avg FROM su")
def street_length_total(spark: SparkSession, d: str) -> DataFrame:
    return stats.edge_totals(_undirected(spark, d), "street").select("street_count", F.round("street_length_total", 2).alias("street_length_total"), F.round("street_length_avg", 4).alias("street_length_avg"))


@query(_STREETS + " SELECT round(avg((u = v)::INT), 6) self_loop_proportion FROM su")
def self_loop_proportion(spark: SparkSession, d: str) -> DataFrame:
    return stats.self_loop_proportion(_undirected(spark, d)).select(F.round("self_loop_proportion", 6).alias("self_loop_proportion"))


@query(_STREETS + f" SELECT round(sum(length) / nullif(sum({haversine('uy', 'ux', 'vy', 'vx')}), 0), 5) circuity_avg FROM su")
def circuity_avg(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return stats.circuity_avg(g, _undirected(spark, d)).select(F.round("circuity_avg", 5).alias("circuity_avg"))


@query(_SPN_STREETS + f""" SELECT (SELECT count(*) FROM gn)::BIGINT n, (SELECT count(*) FROM ge)::BIGINT m, round(2 * (SELECT count(*) FROM ge) / (SELECT count(*) FROM gn), 6) k_avg,
    round((SELECT sum(length) FROM ge), 2) edge_length_total, round((SELECT avg(length) FROM ge), 4) edge_length_avg,
    round((SELECT sum(street_count) / count(*) FROM spn), 6) streets_per_node_avg, (SELECT count(*) FROM spn WHERE street_count >= 2)::BIGINT intersection_count,
    count(*)::BIGINT street_segment_count, round(sum(length), 2) street_length_total, round(avg(length), 4) street_length_avg, round(avg((u = v)::INT), 6) self_loop_proportion,
    round(sum(length) / nullif(sum({haversine('uy', 'ux', 'vy', 'vx')}), 0), 5) circuity_avg, round((SELECT count(*) FROM gn) / 1e3, 6) node_density_km FROM su""")
def basic_stats(spark: SparkSession, d: str) -> DataFrame:
    out = stats.basic_stats(graph(spark, d, geometry=True), area=1e9)
    digits = {"k_avg": 6, "edge_length_total": 2, "edge_length_avg": 4, "streets_per_node_avg": 6, "street_length_total": 2, "street_length_avg": 4, "self_loop_proportion": 6, "circuity_avg": 5, "node_density_km": 6}
    return out.select("n", "m", "intersection_count", "street_segment_count", *[F.round(c, k).alias(c) for c, k in digits.items()])


_HIST = _BEARINGS + """, bb AS (SELECT bearing b FROM gb WHERE u <> v AND length >= 0 AND bearing IS NOT NULL UNION ALL SELECT ((bearing - 180) % 360 + 360) % 360 FROM gb WHERE u <> v AND length >= 0 AND bearing IS NOT NULL),
hist AS (SELECT i::INTEGER bin, coalesce(w, 0)::DOUBLE weight FROM range(36) r(i) LEFT JOIN
  (SELECT ((least(floor(round(b, 6) / 5), 71)::BIGINT + 1) % 72) // 2 k, count(*) w FROM bb GROUP BY 1) ON k = i)"""


def _histogram(spark: SparkSession, d: str) -> DataFrame:
    g = attributes.add_bearings(graph(spark, d))
    return stats.bearing_histogram(g.withColumn("bearing", F.col("bearing")))


@query()
def bearing_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _histogram(spark, d).select("bin", "weight")


@query()
def orientation_entropy(spark: SparkSession, d: str) -> DataFrame:
    return stats.orientation_entropy(_histogram(spark, d)).select(F.round("orientation_entropy", 6).alias("orientation_entropy"))


@query()
def orientation_rose(spark: SparkSession, d: str) -> DataFrame:
    return stats.orientation_rose(_histogram(spark, d)).select("bin", F.round("share", 6).alias("share"), F.round("radius", 6).alias("radius"))


for _n, _s in (("bearing_histogram", "SELECT bin, weight FROM hist"),
               ("orientation_entropy", "SELECT round(-sum(CASE WHEN weight > 0 THEN weight / t * ln(weight / t) END), 6) orientation_entropy FROM hist, (SELECT sum(weight) t FROM hist)"),
               ("orientation_rose", "SELECT bin, round(weight / t, 6) share, round(sqrt(weight / t), 6) radius FROM hist, (SELECT sum(weight) t FROM hist)")):
    SQL[_n] = _HIST.replace("round(b, 6)", "b") + " " + _s

_WIDTHS = {"motorway": 8.0, "primary": 6.0, "secondary": 5.0, "footway": 1.0}
_WIDTH_SQL = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _WIDTHS.items()) + " ELSE 4.0 END"


@query(G + f" SELECT osmid, (max(w) * max(w))::DOUBLE size FROM (SELECT u osmid, {_WIDTH_SQL} w FROM ge UNION ALL SELECT v, {_WIDTH_SQL} FROM ge) GROUP BY osmid")
def figure_ground(spark: SparkSession, d: str) -> DataFrame:
    return stats.figure_ground(edges(spark, d), _WIDTHS)[1]


@query(G + """ SELECT osmid, least(floor((ceil((elevation - lo) / ((hi - lo) / 5)) - 1))::INT, 4) bin FROM gn, (SELECT min(elevation) lo, max(elevation) hi FROM gn) WHERE elevation IS NOT NULL AND elevation > lo
    UNION ALL SELECT osmid, 0 FROM gn WHERE elevation = (SELECT min(elevation) FROM gn)""")
def color_bins_equal_width(spark: SparkSession, d: str) -> DataFrame:
    return attributes.binned_values(nodes(spark, d).where("elevation IS NOT NULL"), "elevation", 5).select("osmid", "bin")


@query(G + """ SELECT osmid, (elevation > q[1])::INT + (elevation > q[2])::INT + (elevation > q[3])::INT bin FROM gn, (SELECT quantile_cont(elevation, [0.25, 0.5, 0.75]) q FROM gn) WHERE elevation IS NOT NULL""")
def color_bins_equal_size(spark: SparkSession, d: str) -> DataFrame:
    return attributes.binned_values(nodes(spark, d).where("elevation IS NOT NULL"), "elevation", 4, True).select("osmid", "bin")


@query(G + " SELECT osmid, round((elevation - lo) / nullif(hi - lo, 0) * 0.8 + 0.1, 9) AS position FROM gn, (SELECT min(elevation) lo, max(elevation) hi FROM gn) WHERE elevation IS NOT NULL")
def color_positions(spark: SparkSession, d: str) -> DataFrame:
    return attributes.scaled_values(nodes(spark, d).where("elevation IS NOT NULL"), "elevation", 0.1, 0.9).select("osmid", F.round("position", 9).alias("position"))


@query(G + " SELECT min(x) west, min(y) south, max(x) east, max(y) north FROM gn")
def total_bounds(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))


# ---- forms, validation, truncation --------------------------------------------

@query(G + " SELECT u, v, key, length FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY coalesce(length, 1), key) r FROM ge) WHERE r = 1")
def to_digraph(spark: SparkSession, d: str) -> DataFrame:
    return convert.to_digraph(edges(spark, d)).select("u", "v", "key", "length")


@query(_STREETS + """ SELECT u, v, key, "from", "to", ord FROM su""")
def to_undirected(spark: SparkSession, d: str) -> DataFrame:
    return convert.to_undirected(graph(spark, d, geometry=True)).select("u", "v", "key", "from", "to", "ord")


@query(G + """ SELECT 'node_without_id' AS rule, (SELECT count(*) FROM gn WHERE osmid IS NULL)::BIGINT violations UNION ALL SELECT 'node_without_place', (SELECT count(*) FROM gn WHERE x IS NULL OR y IS NULL)
    UNION ALL SELECT 'edge_without_id', (SELECT count(*) FROM ge WHERE u IS NULL OR v IS NULL OR key IS NULL) UNION ALL SELECT 'edge_without_length', (SELECT count(*) FROM ge WHERE length IS NULL OR length < 0)
    UNION ALL SELECT 'edge_without_way', (SELECT count(*) FROM ge WHERE osmid IS NULL) UNION ALL SELECT 'node_repeated', 0 UNION ALL SELECT 'edge_repeated', 0 UNION ALL SELECT 'edge_end_unknown', 0""")
def validate_graph(spark: SparkSession, d: str) -> DataFrame:
    return convert.validate_graph(graph(spark, d))


_BOX = (-60.0, -40.0, 60.0, 45.0)
_IN_BOX = "x BETWEEN -60 AND 60 AND y BETWEEN -40 AND 45"


@query(G + f", k AS (SELECT osmid FROM gn WHERE {_IN_BOX}) SELECT u, v, key FROM ge WHERE u IN (SELECT osmid FROM k) AND v IN (SELECT osmid FROM k)")
def truncate_bbox(spark: SparkSession, d: str) -> DataFrame:
    return truncate.truncate_bbox(graph(spark, d), _BOX).edges.select("u", "v", "key")


@query(G + f", i AS (SELECT osmid FROM gn WHERE {_IN_BOX}) SELECT osmid FROM i UNION SELECT v FROM ge WHERE u IN (SELECT osmid FROM i) UNION SELECT u FROM ge WHERE v IN (SELECT osmid FROM i)")
def truncate_bbox_by_edge(spark: SparkSession, d: str) -> DataFrame:
    return truncate.truncate_bbox(graph(spark, d), _BOX, by_edge=True).nodes.select("osmid")


_TRIANGLE = [[(-100.0, -60.0), (120.0, -30.0), (10.0, 70.0), (-100.0, -60.0)]]


@query(G + """, t AS (SELECT *, (220.0 * (y + 60) - 30.0 * (x + 100)) s1, (-110.0 * (y + 30) - 100.0 * (x - 120)) s2, (-110.0 * (y - 70) + 130.0 * (x - 10)) s3 FROM gn)
    SELECT osmid FROM t WHERE s1 >= 0 AND s2 >= 0 AND s3 >= 0""")
def truncate_polygon(spark: SparkSession, d: str) -> DataFrame:
    return truncate.truncate_polygon(graph(spark, d), _TRIANGLE).nodes.select("osmid")


# ---- nearest, components, paths -----------------------------------------------

def _points(spark: SparkSession, d: str) -> DataFrame:
    """A place a little off every node."""
    return nodes(spark, d).select(F.col("osmid").alias("point_id"), (F.col("x") + 0.0007).alias("x"), (F.col("y") - 0.0004).alias("y"))


@query(G + f""", q AS (SELECT osmid point_id, x + 0.0007 x, y - 0.0004 y FROM gn),
    c AS (SELECT point_id, osmid, {haversine('q.y', 'q.x', 'g.y', 'g.x')} dist FROM q, gn g)
    SELECT point_id, osmid, round(dist, 3) dist FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(dist, 6), osmid) r FROM c) WHERE r = 1""")
def nearest_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest_nodes(nodes(spark, d), _points(spark, d)).select("point_id", "osmid", F.round("dist", 3).alias("dist"))


@query(_LINES + """, q AS (SELECT osmid point_id, x + 0.0007 px, y - 0.0004 py FROM gn),
    c AS (SELECT point_id, u, v, key, px, py, ux, uy, dx, dy, greatest(0, least(1, coalesce(((px - ux) * dx + (py - uy) * dy) / nullif(dx * dx + dy * dy, 0), 0))) t FROM q, sg),
    e AS (SELECT point_id, u, v, key, sqrt(power(ux + t * dx - px, 2) + power(uy + t * dy - py, 2)) dist FROM c)
    SELECT point_id, u, v, key, round(dist, 9) dist FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(dist, 10), u, v, key) r FROM e) WHERE r = 1""")
def nearest_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = convert.edge_points(graph(spark, d, geometry=True))
    return nearest.nearest_edges(lines, _points(spark, d)).select("point_id", "u", "v", "key", F.round("dist", 9).alias("dist"))


_COMPONENTS = "WITH RECURSIVE " + GRAPH_SQL + """, l AS (SELECT u a, v b FROM ge UNION SELECT v, u FROM ge),
best(osmid, c) USING KEY (osmid) AS (SELECT osmid, osmid FROM gn UNION
  SELECT l.b, min(n.c) FROM best n JOIN l ON l.a = n.osmid JOIN recurring.best o ON o.osmid = l.b WHERE n.c < o.c GROUP BY l.b)"""


@query(_COMPONENTS + " SELECT osmid, c component FROM best")
def components(spark: SparkSession, d: str) -> DataFrame:
    return paths.weak_components(nodes(spark, d), edges(spark, d))


@query(_COMPONENTS + ", top AS (SELECT c FROM best GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT osmid FROM best WHERE c = (SELECT c FROM top)")
def largest_component(spark: SparkSession, d: str) -> DataFrame:
    return paths.largest_component(graph(spark, d)).nodes.select("osmid")


@query("WITH RECURSIVE " + GRAPH_SQL + """, r(a, b) AS (SELECT osmid, osmid FROM gn UNION SELECT r.a, ge.v FROM r JOIN ge ON ge.u = r.b)
    SELECT x.a osmid, min(x.b) component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a""")
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return paths.strong_components(nodes(spark, d), edges(spark, d))


_HUB = "(SELECT u FROM ge GROUP BY u ORDER BY count(*) DESC, u LIMIT 1)"
_DIST = "WITH RECURSIVE " + GRAPH_SQL + f""", l AS (SELECT u, v, min(coalesce(length, 1)) w FROM ge WHERE u <> v GROUP BY u, v), src AS (SELECT {_HUB} s),
best(osmid, dist) USING KEY (osmid) AS (SELECT s, 0.0::DOUBLE FROM src UNION
  SELECT l.v, min(n.dist + l.w) FROM best n JOIN l ON l.u = n.osmid LEFT JOIN recurring.best o ON o.osmid = l.v WHERE o.osmid IS NULL OR n.dist + l.w < o.dist GROUP BY l.v)"""


def _hub(spark: SparkSession, d: str) -> int:
    row = edges(spark, d).groupBy("u").count().orderBy(F.desc("count"), "u").first()
    return row["u"] if row else -1


@query(_DIST + " SELECT osmid, round(dist, 3) dist FROM best")
def sssp_distance(spark: SparkSession, d: str) -> DataFrame:
    return paths.distances_from(edges(spark, d), _hub(spark, d)).select("osmid", F.round("dist", 3).alias("dist"))


@query(_DIST + " SELECT u, v, key FROM ge WHERE u IN (SELECT osmid FROM best WHERE dist <= 1500) AND v IN (SELECT osmid FROM best WHERE dist <= 1500)")
def truncate_dist(spark: SparkSession, d: str) -> DataFrame:
    return truncate.truncate_dist(graph(spark, d), _hub(spark, d), 1500.0).edges.select("u", "v", "key")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """From the node with most edges to every node."""
    return nodes(spark, d).select(F.col("osmid").alias("route_id"), F.lit(_hub(spark, d)).alias("orig"), F.col("osmid").alias("dest"))


@query(_DIST + " SELECT gn.osmid route_id, round(dist, 3) AS cost FROM gn LEFT JOIN best USING (osmid)")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return paths.shortest_paths(_pairs(spark, d), edges(spark, d)).select("route_id", F.round("cost", 3).alias("cost"))


@query(_DIST + " SELECT gn.osmid route_id, round(dist, 3) AS length, true AS joined FROM gn JOIN best USING (osmid) WHERE dist > 0")
def route_edges(spark: SparkSession, d: str) -> DataFrame:
    """Length of each route's edges, and whether every edge starts where the one before ends, from the origin to the destination."""
    lines = edges(spark, d)
    routes = paths.shortest_paths(_pairs(spark, d), lines)
    steps = convert.route_edges(routes, lines).groupBy("route_id").agg(F.round(F.sum("length"), 3).alias("length"), F.array_sort(F.collect_list(F.struct("pos", "u", "v"))).alias("s"))
    heads, tails = F.transform("s", lambda x: x["u"]), F.transform("s", lambda x: x["v"])
    chained = F.slice(heads, 2, F.size("s") - 1) == F.slice(tails, 1, F.size("s") - 1)
    ends = (F.get(heads, F.lit(0)) == _hub(spark, d)) & (F.element_at(tails, -1) == F.col("route_id"))
    return steps.select("route_id", "length", (chained & ends).alias("joined"))


@query()
def k_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths.shortest_paths(_pairs(spark, d), edges(spark, d), k=3).select("route_id", "rank", F.round("cost", 3).alias("cost"), F.size("nodes").alias("n_nodes"))


# ---- topology -----------------------------------------------------------------

@query(G + """, inc AS (SELECT u o, v x, 1 f, 0 b FROM ge UNION ALL SELECT v, u, 0, 1 FROM ge),
    s AS (SELECT o, count(DISTINCT x) n, sum(f) f, sum(b) b, bool_or(o = x) loop FROM inc GROUP BY o)
    SELECT osmid, coalesce(loop OR f = 0 OR b = 0 OR NOT (n = 2 AND f + b IN (2, 4)), true) is_endpoint FROM gn LEFT JOIN s ON o = osmid""")
def endpoints(spark: SparkSession, d: str) -> DataFrame:
    return simplify.endpoints(nodes(spark, d), edges(spark, d))


@query("WITH RECURSIVE " + GRAPH_SQL + """, inc AS (SELECT u o, v x, 1 f, 0 b FROM ge UNION ALL SELECT v, u, 0, 1 FROM ge),
    s AS (SELECT o, count(DISTINCT x) n, sum(f) f, sum(b) b, bool_or(o = x) loop FROM inc GROUP BY o),
    ep AS (SELECT osmid, coalesce(loop OR f = 0 OR b = 0 OR NOT (n = 2 AND f + b IN (2, 4)), true) e FROM gn LEFT JOIN s ON o = osmid),
    fi AS (SELECT u, v, min(key) key FROM ge GROUP BY u, v),
    w AS (SELECT g.u u0, g.v v1, g.key k, g.u prev, g.v cur, [g.length] ls, [g.osmid] ways FROM ge g JOIN ep a ON a.osmid = g.u AND a.e JOIN ep b ON b.osmid = g.v LEFT JOIN fi ON fi.u = g.u AND fi.v = g.v AND fi.key = g.key
        WHERE b.e OR fi.key IS NOT NULL
      UNION ALL SELECT u0, v1, k, w.cur, n.v, list_append(ls, n.length), list_append(ways, n.osmid) FROM w JOIN ep ON ep.osmid = w.cur AND NOT ep.e JOIN ge n ON n.u = w.cur
        JOIN fi ON fi.u = n.u AND fi.v = n.v AND fi.key = n.key WHERE n.v <> w.prev)
    SELECT u0 u, cur v, (row_number() OVER (PARTITION BY u0, cur ORDER BY v1, k) - 1)::INTEGER key, round(list_sum(ls), 3) length, len(list_distinct(ways))::INTEGER n_ways,
      CASE WHEN len(ls) > 1 THEN len(ls)::INTEGER + 1 END n_points FROM w JOIN ep ON ep.osmid = cur
      WHERE ep.e OR NOT EXISTS (SELECT 1 FROM fi WHERE fi.u = w.cur AND fi.v <> w.prev)""")
def simplify_graph(spark: SparkSession, d: str) -> DataFrame:
    return simplify.simplify_graph(graph(spark, d)).edges.select("u", "v", "key", F.round("length", 3).alias("length"), F.size("osmid").alias("n_ways"), F.size("geometry").alias("n_points"))


def _consolidated(spark: SparkSession, d: str, reconnect: bool) -> StreetGraph:
    g = graph(spark, d, geometry=True)
    return simplify.consolidate_intersections(g.with_(nodes=g.nodes.select("osmid", "x", "y")), 15.0, dead_ends=False, reconnect=reconnect)


@query()
def consolidate_intersections(spark: SparkSession, d: str) -> DataFrame:
    return _consolidated(spark, d, False).nodes.select("osmid", F.size("osmid_original").alias("n"), F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


_TOUCH = "a.osmid <> b.osmid AND abs(a.y - b.y) < 0.001 AND " + haversine("a.y", "a.x", "b.y", "b.x") + " <= 30"


@query("WITH RECURSIVE" + _SPN[len("WITH"):] + f""", c AS (SELECT gn.osmid, x, y FROM gn JOIN spn USING (osmid) WHERE street_count > 1),
    np AS (SELECT a.osmid u, b.osmid v FROM c a JOIN c b ON {_TOUCH}),
    cl(osmid, g) USING KEY (osmid) AS (SELECT osmid, osmid FROM c UNION
      SELECT np.v, min(n.g) FROM cl n JOIN np ON np.u = n.osmid JOIN recurring.cl o ON o.osmid = np.v WHERE n.g < o.g GROUP BY np.v),
    wi AS (SELECT u, v FROM ge JOIN cl a ON a.osmid = u JOIN cl b ON b.osmid = v WHERE a.g = b.g),
    li AS (SELECT u, v FROM wi UNION SELECT v, u FROM wi),
    pt(osmid, g) USING KEY (osmid) AS (SELECT osmid, osmid FROM c UNION
      SELECT li.v, min(n.g) FROM pt n JOIN li ON li.u = n.osmid JOIN recurring.pt o ON o.osmid = li.v WHERE n.g < o.g GROUP BY li.v)
    SELECT g osmid, count(*)::INTEGER n, max(osmid) last_original FROM pt GROUP BY g""")
def consolidated_groups(spark: SparkSession, d: str) -> DataFrame:
    return _consolidated(spark, d, False).nodes.select("osmid", F.size("osmid_original").alias("n"), F.array_max("osmid_original").alias("last_original"))


@query()
def consolidated_edges(spark: SparkSession, d: str) -> DataFrame:
    return _consolidated(spark, d, True).edges.select("u", "v", "key", "u_original", "v_original", "ord", F.round("length", 3).alias("length"), F.size("geometry").alias("n_points"))


@query()
def sample_points(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_points(convert.edge_points(graph(spark, d, geometry=True)), 1000, seed=7)


@query(_LINES + " SELECT u, v, key, (greatest(round_even(sum(sqrt(dx * dx + dy * dy)) / 0.01, 0), 1) + 1)::INTEGER n_points FROM sg GROUP BY u, v, key")
def interpolate_points(spark: SparkSession, d: str) -> DataFrame:
    lines = convert.edge_points(graph(spark, d, geometry=True))
    return geo.interpolate_lines(lines, 0.01, ["u", "v", "key"]).select("u", "v", "key", F.size("points").alias("n_points"))


@query(_LINES + """ SELECT ord, i::INTEGER pos, round(p[i].x, 9) x, round(p[i].y, 9) y FROM (SELECT ord, p, unnest(range(1, len(p) + 1)) i FROM ln WHERE geom_wkt IS NOT NULL)""")
def edge_geometry(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d, geometry=True)
    rows = g.edges.where("geom_wkt IS NOT NULL").select("ord", F.posexplode("geometry").alias("pos", "p"))
    return rows.select("ord", (F.col("pos") + 1).alias("pos"), F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


# ---- text forms ---------------------------------------------------------------

@query(G + " SELECT osmid, sha1('node/' || osmid) || '.json' cache_name FROM gn")
def cache_names(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("osmid", osm.cache_key(F.concat(F.lit("node/"), F.col("osmid").cast("string"))).alias("cache_name"))


@query("""SELECT area_id, part::INTEGER part, array_to_string(list_transform(rings[1], lambda p: format('{:.6f} {:.6f}', p.y, p.x)), ' ') AS place
    FROM (SELECT area_id, unnest(polygons) rings, unnest(range(1, len(polygons) + 1)) part FROM areas)""")
def polygon_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "areas").select("area_id", F.posexplode("polygons").alias("pos", "rings"))
    return parts.select("area_id", (F.col("pos") + 1).alias("part"), osm.polygon_text(F.element_at("rings", 1)).alias("place"))


@query("""SELECT query, place FROM (SELECT c_mktsegment query, c_name place, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) r FROM customer) WHERE r = 2""")
def geocode_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("query"), F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("importance"), F.lit("Polygon").alias("geom_type"), F.col("c_name").alias("place"))
    return osm.pick_geocode(rows, 2).select("query", "place")


@query("""SELECT query, place FROM (SELECT c_mktsegment query, c_name place, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) r FROM customer WHERE c_nationkey % 2 = 0) WHERE r = 1""")
def geocode_first_polygon(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("c_nationkey") % 2 == 0, "MultiPolygon").otherwise("Point")
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("query"), F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("importance"), kind.alias("geom_type"), F.col("c_name").alias("place"))
    return osm.pick_geocode(rows).select("query", "place")


@query()
def graphml_lines(spark: SparkSession, d: str) -> DataFrame:
    return osm.graphml_lines(graph(spark, d))


@query()
def way_node_lists(spark: SparkSession, d: str) -> DataFrame:
    return osm.way_node_lists(build.create_graph(table(spark, d, "elements")).edges)
