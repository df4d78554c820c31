import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from roadframe.functions import geo
from roadframe.model import InsufficientResponseError
from roadframe.operators import entry
from roadframe.sources import osm

ELEMENTS = ("type string, id bigint, version int, lat double, lon double, nodes array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, "
            "tags map<string,string>, visible boolean, ingested_at timestamp")
NOW = datetime(2024, 1, 1)
STEP = 0.001  # about 111 m


def node(i, x, y, **tags):
    return ("node", i, 1, float(y), float(x), None, None, tags, True, NOW)


def way(i, refs, **tags):
    return ("way", i, 1, None, None, refs, None, tags, True, NOW)


def town(spark):
    """A street 1-2-3-4-5-6 along the equator, a side street 3-7, a far one 8-9 within the box, and one node alone on its way."""
    rows = [node(i, i * STEP, 0) for i in range(1, 7)] + [node(7, 3 * STEP, STEP), node(8, 2 * STEP, 3 * STEP), node(9, 3 * STEP, 3 * STEP), node(10, 2 * STEP, 2 * STEP, amenity="bench")]
    rows += [way(100, [1, 2, 3, 4, 5, 6], highway="residential"), way(101, [3, 7], highway="service"), way(102, [8, 9], highway="residential", building="yes"), way(103, [10], highway="residential"),
             way(104, [1, 2], highway="no"), ("relation", 5, 1, None, None, None, [("way", 102, "outer")], {"type": "multipolygon", "building": "yes"}, True, NOW)]
    return spark.createDataFrame(rows, ELEMENTS)


BOX = (0.5 * STEP, -0.5 * STEP, 4.5 * STEP, 3.5 * STEP)


def test_graph_from_bbox(spark):
    got = entry.graph_from_bbox(town(spark), BOX)
    nodes = {r.osmid: r.street_count for r in got.nodes.collect()}
    # 2 and 4 only pass; 6 lies outside the box but within the margin, so 3-6 is a street when streets are counted
    assert nodes == {1: 1, 3: 3, 7: 1}
    assert {(r.u, r.v): round(r.length) for r in got.edges.collect()} == {(1, 3): 222, (3, 1): 222, (3, 7): 111, (7, 3): 111}
    whole = entry.graph_from_bbox(town(spark), BOX, simplified=False, retain_all=True)
    assert {r.osmid for r in whole.nodes.collect()} == {1, 2, 3, 4, 7, 8, 9, 10}  # also the node without an edge
    edge = entry.graph_from_bbox(town(spark), BOX, simplified=False, retain_all=True, truncate_by_edge=True)
    assert {r.osmid for r in edge.nodes.collect()} == {1, 2, 3, 4, 5, 7, 8, 9, 10}
    with pytest.raises(InsufficientResponseError):
        entry.graph_from_bbox(town(spark), (50.0, 50.0, 51.0, 51.0))
    with pytest.raises(ValueError):
        entry.graph_from_polygon(town(spark), [[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]])


def test_graph_from_point_and_place(spark):
    near = entry.graph_from_point(town(spark), (0.0, 3 * STEP), 150.0, "network", simplified=False)
    assert {r.osmid for r in near.nodes.collect()} == {2, 3, 4, 7}
    square = [[BOX[0], BOX[1]], [BOX[2], BOX[1]], [BOX[2], BOX[3]], [BOX[0], BOX[3]], [BOX[0], BOX[1]]]
    body = json.dumps([{"lat": "0.0", "lon": str(3 * STEP), "importance": 0.2, "geojson": {"type": "Point", "coordinates": [3 * STEP, 0.0]}, "boundingbox": ["-1", "1", "-2", "2"]},
                       {"lat": "9", "lon": "9", "importance": 0.1, "geojson": {"type": "Polygon", "coordinates": [square]}}])
    answers = osm.geocode_answers(spark.createDataFrame([("town", body), ("none", "[]"), ("broken", None)], "query string, body string"))
    first = answers.where("ord = 0").first()
    assert (first.bbox_west, first.bbox_south, first.bbox_east, first.bbox_north) == (-2, -1, 2, 1)
    assert osm.geocode(answers, "town") == (0.0, 3 * STEP)
    with pytest.raises(InsufficientResponseError):
        osm.geocode(answers, "none")
    with pytest.raises(TypeError):
        osm.geocode_polygons(answers, "town", 1)
    by_place = entry.graph_from_place(town(spark), answers, "town", simplified=False)
    assert {r.osmid for r in by_place.nodes.collect()} == {1, 2, 3, 4, 7}
    by_address = entry.graph_from_address(town(spark), answers, "town", 150.0, simplified=False)
    assert {r.osmid for r in by_address.nodes.collect()} == {2, 3, 4, 7}


def test_features(spark):
    got = [(r.element, r.id) for r in entry.features_from_bbox(town(spark), BOX, {"amenity": True, "building": "yes"}).collect()]
    assert got == [("node", 10), ("way", 102)]
    assert [(r.element, r.id) for r in entry.features_from_point(town(spark), (2 * STEP, 2 * STEP), {"amenity": ["bench", "bar"]}, 50.0).collect()] == [("node", 10)]
    every = entry.features_from_polygon(town(spark), None, {}).collect()
    assert [(r.element, r.id) for r in every] == [("node", 10), ("way", 100), ("way", 101), ("way", 102), ("way", 104)]


def test_xml(spark, tmp_path):
    lines = ['<?xml version="1.0"?>', '<osm version="0.6">', *[f'<node id="{i}" lat="0.0" lon="{i * STEP}"/>' for i in (1, 2, 3)],
             '<node id="4" lat="1.0" lon="1.0"><tag k="amenity" v="bench"/></node>', '<node id="5" lat="1.1" lon="1.0"/>',
             '<way id="7"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/></way>', '<way id="8"><nd ref="4"/><nd ref="5"/><tag k="highway" v="path"/></way>', "</osm>"]
    import bz2

    path = tmp_path / "town.osm.bz2"
    path.write_bytes(bz2.compress("\n".join(lines).encode()))
    graph = entry.graph_from_xml(spark, str(path))
    assert {(r.u, r.v) for r in graph.edges.collect()} == {(1, 3), (3, 1)}
    assert entry.graph_from_xml(spark, str(path), retain_all=True, simplified=False).edges.count() == 6
    assert [(r.element, r.id) for r in entry.features_from_xml(spark, str(path), None, {"amenity": True}).collect()] == [("node", 4)]


def test_polygon_tests_agree_with_plain_ones(spark):
    shell = [(math.cos(k / 50 * math.pi) * (5 + k % 3), math.sin(k / 50 * math.pi) * (5 + k % 3)) for k in range(100)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    parts = geo.as_parts([[shell, hole], [[(4.0, -1.0), (9.0, -1.0), (9.0, 1.0), (4.0, 1.0)]]])
    rows = [(i, -8 + 0.37 * (i % 48), -8 + 0.41 * (i // 48)) for i in range(48 * 40)]
    points = spark.createDataFrame(rows, "i bigint, x double, y double")
    x, y = F.col("x"), F.col("y")
    got = {r.i: (r.inside, r.near) for r in points.select("i", geo.inside_parts(x, y, parts).alias("inside"), geo.within_distance(x, y, parts, 50_000.0).alias("near")).collect()}

    def sides(part):
        return [s for r in part for s in zip(r[:-1], r[1:])]

    def inside(px, py, part):
        return sum((a[1] <= py) != (b[1] <= py) and a[0] + (py - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) > px for a, b in sides(part)) % 2 == 1

    def away(px, py, part):
        k = math.cos(math.radians(py))
        best = math.inf
        for (ax, ay), (bx, by) in sides(part):
            dx, dy = (bx - ax) * k, by - ay
            t = max(0.0, min(1.0, ((px - ax) * k * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot((px - ax) * k - t * dx, py - ay - t * dy))
        return math.radians(best) * 6371009

    for i, px, py in rows:
        want = any(inside(px, py, p) for p in parts)
        assert got[i] == (want, want or min(away(px, py, p) for p in parts) <= 50_000.0)
    border = spark.createDataFrame([(1.5, 1.0), (9.0, 0.5), (1.5, 1.5)], "x double, y double")
    assert [r[0] for r in border.select(geo.inside_parts(x, y, parts)).collect()] == [True, True, False]


def test_files_round_trip(spark, tmp_path):
    import glob
    import sqlite3
    import xml.etree.ElementTree as ET

    whole = entry.graph_from_bbox(town(spark), BOX, simplified=False, retain_all=True)
    osm.write_osm_xml(whole, f"{tmp_path}/xml", way_tag_aggs={"highway": F.max})
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/xml/*/part-*")))
    tree = ET.fromstring(text)
    assert {w.get("id"): [n.get("ref") for n in w.findall("nd")] for w in tree.findall("way")} == {"100": ["1", "2", "3", "4"], "101": ["3", "7"], "102": ["8", "9"]}
    again = osm.read_osm_xml(spark, f"{tmp_path}/xml/*")
    assert {r.id: r.tags for r in again.where("type = 'way'").collect()} == {100: {"highway": "residential"}, 101: {"highway": "service"}, 102: {"highway": "residential"}}
    with pytest.raises(ValueError):
        osm.write_osm_xml(entry.graph_from_bbox(town(spark), BOX), f"{tmp_path}/no")

    made = entry.graph_from_bbox(town(spark), BOX)
    osm.write_graphml_parts(made, f"{tmp_path}/parts", sequential_ids=True)
    osm.write_graphml(made, f"{tmp_path}/one.graphml")
    for path in (f"{tmp_path}/parts/*", f"{tmp_path}/one.graphml"):
        back = osm.read_graphml(spark, path)
        assert back.attrs["crs"] == 4326 and back.attrs["simplified"] is True
        assert {(r.osmid, r.x, r.y, r.street_count) for r in back.nodes.collect()} == {(r.osmid, r.x, r.y, r.street_count) for r in made.nodes.collect()}
        rows = {(r.u, r.v): r for r in back.edges.withColumn("ways", osm.list_items(F.col("osmid"))).collect()}
        assert set(rows) == {(1, 3), (3, 1), (3, 7), (7, 3)} and rows[1, 3].ways == ["100"] and len(rows[1, 3].geometry) == 3 and rows[1, 3].length == pytest.approx(222.39, abs=0.1)
    ids = ET.fromstring("".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/parts/*/part-*")))).iter("{http://graphml.graphdrawing.org/xmlns}edge")
    assert sorted(int(e.get("id")) for e in ids) == [0, 1, 2, 3]
    typed = osm.read_graphml(spark, f"{tmp_path}/one.graphml", edge_types={"length": "string"})
    assert dict(typed.edges.dtypes)["length"] == "string"

    osm.write_geopackage(made, f"{tmp_path}/town.gpkg")
    with sqlite3.connect(f"{tmp_path}/town.gpkg") as db:
        assert [r[0] for r in db.execute("SELECT count(*) FROM nodes UNION ALL SELECT count(*) FROM edges")] == [3, 2]
        assert db.execute("SELECT geom FROM nodes WHERE osmid = 3").fetchone()[0][:4] == b"GP\x00\x01"


def test_json_answers(spark, tmp_path):
    url = "https://example.org/api?data=x"
    body = {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"a": "b"}}]}
    (tmp_path / osm.cache_name(url)).write_text(json.dumps(body))
    assert [(r.type, r.id, r.tags) for r in osm.read_cached_answers(spark, str(tmp_path), url).collect()] == [("node", 1, {"a": "b"})]


def test_streams(spark, tmp_path):
    from roadframe.streaming.snap import latest_rows, start_snapping, start_updates, windowed_counts

    def arrive(name, rows):
        spark.createDataFrame([(datetime(2024, 1, d, h), kind, v) for d, h, kind, v in rows], "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/in/{name}")

    def run():
        events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in/*")
        start_updates(windowed_counts(events), f"{tmp_path}/counts").awaitTermination()
        return {(r.start.day, r.start.hour, r.event_type): (r.n, r.total) for r in latest_rows(spark.read.parquet(f"{tmp_path}/counts/out/*"), ["start", "event_type"]).collect()}

    arrive("a", [(1, 0, "x", 1.0), (1, 0, "x", 2.0), (5, 0, "y", 1.0)])
    assert run() == {(1, 0, "x"): (2, 3.0), (5, 0, "y"): (1, 1.0)}
    arrive("b", [(1, 0, "x", 9.0), (4, 12, "x", 4.0), (5, 0, "y", 2.0)])  # the first is four days late: its window is closed
    assert run() == {(1, 0, "x"): (2, 3.0), (4, 12, "x"): (1, 4.0), (5, 0, "y"): (2, 3.0)}
    spark.createDataFrame([(1, 0.1, 0.0), (2, None, 1.0)], "point_id bigint, x double, y double").write.parquet(f"{tmp_path}/places")
    places = spark.readStream.schema("point_id bigint, x double, y double").parquet(f"{tmp_path}/places")
    nodes = spark.createDataFrame([(7, 0.0, 0.0), (8, 1.0, 0.0)], "osmid bigint, x double, y double")
    start_snapping(places, nodes, f"{tmp_path}/snap").awaitTermination()
    assert {r.point_id: r.osmid for r in spark.read.parquet(f"{tmp_path}/snap/out/*").collect()} == {1: 7, 2: None}


def test_validation_ladder(spark):
    from roadframe.model import StreetGraph, ValidationError
    from roadframe.operators import convert

    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "osmid bigint, x double, y double")
    good = spark.createDataFrame([(1, 2, 0, "a", 1.0)], "u bigint, v bigint, key int, osmid string, length double")
    convert.require_valid(StreetGraph(nodes, good))
    for bad in (StreetGraph(nodes, good, {}), StreetGraph(nodes.drop("x"), good), StreetGraph(nodes, good.drop("length")), StreetGraph(nodes, good.withColumn("v", F.lit(9).cast("bigint"))),
                StreetGraph(nodes.unionByName(nodes), good), StreetGraph(nodes, good.unionByName(good)), StreetGraph(nodes, good.withColumn("length", F.lit(-1.0)))):
        with pytest.raises(ValidationError):
            convert.require_valid(bad)
    convert.require_numeric(good, "length")
    for column in ("osmid", "missing"):
        with pytest.raises(ValidationError):
            convert.require_numeric(good, column)
    with pytest.raises(ValidationError):
        convert.require_numeric(good.withColumn("length", F.lit(None).cast("double")), "length")


def test_public_names():
    import roadframe

    assert {"graph_from_place", "features_from_bbox", "simplify_graph", "log"} <= set(roadframe.__all__) and "llm" not in roadframe.__all__
