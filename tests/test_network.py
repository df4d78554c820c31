import math

import pytest
from pyspark.sql import functions as F

from roadframe.functions import geo
from roadframe.functions.maxspeed import clean_maxspeed, collapse_maxspeeds
from roadframe.model import GraphSimplificationError, StreetGraph
from roadframe.operators import convert, features, nearest, paths, simplify, stats
from roadframe.operators.features import assemble_multipolygon, multipolygon_wkt
from roadframe.operators.filters import parse_clauses
from roadframe.plans import network
from roadframe.sources.osm import chain_nodes

EDGES = "u bigint, v bigint, key int, ord bigint, osmid string, length double, lanes string"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    assert value(spark, geo.great_circle(0, 0, 1, 1)) == pytest.approx(157249.6034105)
    assert value(spark, geo.euclidean(0, 0, 1, 1)) == pytest.approx(math.sqrt(2))
    assert value(spark, geo.bearing(0, 0, 1, 0)) == pytest.approx(0)
    assert value(spark, geo.bearing(0, 0, 0, -1)) == pytest.approx(270)
    xy = value(spark, geo.project(3.0, 0.0, 32631))
    assert (xy.x, xy.y) == pytest.approx((500000, 0))
    assert geo.utm_epsg(3, 10) == 32631 and geo.utm_epsg(3, -10) == 32731 and geo.utm_epsg(0, 85) == 32661


def test_own_zone(spark, tmp_path):
    spots = {1: (3.0, 0.0), 2: (-179.5, 10.0), 3: (180.0, 45.0), 4: (100.0, -33.0), 5: (6.0, 50.0), 6: (20.0, 85.0), 7: (20.0, -81.0)}
    d = write_graph(spark, tmp_path, [(i, *p) for i, p in spots.items()], [(1, 2, 0, 1.0, None)])
    got = {r.osmid: r for r in network.utm_project(spark, d).collect()}
    assert {i: r.epsg for i, r in got.items()} == {1: 32631, 2: 32601, 3: 32660, 4: 32747, 5: 32632, 6: None, 7: None}
    assert (got[1].x, got[1].y) == pytest.approx((500000, 0)) and got[6].x is None and got[7].y is None
    for i in (2, 3, 4, 5):
        xy = value(spark, geo.project(*spots[i], geo.utm_epsg(*spots[i])))
        assert (got[i].x, got[i].y) == pytest.approx((xy.x, xy.y), abs=1e-3)
    assert 6.3e6 < got[4].y < 6.4e6  # the south counts from 10,000 km


def test_maxspeed(spark):
    cases = {"5": 5, "5 mph": 8.0467, "100,2": 100.2, "100 km/h": 100, "100 mph": 160.934, "60|100": 80, "60|100 mph": 128.7472, "signal": None, "100;70": None, "FR:urban": 50}
    for text, kph in cases.items():
        got = value(spark, clean_maxspeed(F.lit(text)))
        assert got is None if kph is None else got == pytest.approx(kph)
    assert value(spark, collapse_maxspeeds(F.array(F.lit("25 mph"), F.lit("30 mph")))) == pytest.approx(44.25685)
    assert value(spark, collapse_maxspeeds(F.array(F.lit("mph"), F.lit("kph")))) is None


def test_clauses():
    assert parse_clauses('["a"]["b"!~"x|y"]') == [("a", None, None), ("b", "!~", "x|y")]
    with pytest.raises(ValueError):
        parse_clauses("highway")


def test_histogram(spark):
    edges = spark.createDataFrame([(1, 2, 0, 1, "1", 1.0, None, 0.0)], EDGES + ", bearing double")
    full = stats.bearing_histogram(edges, 2).orderBy("bin").collect()
    assert [(r.centre, r.weight) for r in full] == [(0.0, 1.0), (180.0, 1.0)]
    assert [r.weight for r in stats.bearing_histogram(edges, 1, undirected=False).collect()] == [1.0]


def chain(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0)], "osmid bigint, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0, 1, "a", 1.0, None), (2, 1, 0, 2, "a", 1.0, None), (2, 3, 0, 3, "b", 1.0, None), (3, 2, 0, 4, "b", 1.0, None)], EDGES)
    return StreetGraph(nodes, edges)


def test_nan_is_missing(spark):
    graph = chain(spark)
    lanes = graph.edges.withColumn("lanes", F.when(F.col("u") == 2, F.lit(float("nan"))).cast("double"))
    out = simplify.simplify_graph(graph.with_(edges=lanes), edge_attrs=["lanes"])
    assert {r.osmid for r in out.nodes.collect()} == {1, 3} and all(r.lanes == [] for r in out.edges.collect())


def test_simplify(spark):
    graph = chain(spark)
    out = simplify.simplify_graph(graph, edge_attrs=["lanes"], track_merged=True)
    assert {r.osmid for r in out.nodes.collect()} == {1, 3}
    rows = {(r.u, r.v): r for r in out.edges.collect()}
    assert set(rows) == {(1, 3), (3, 1)} and rows[1, 3].length == 2.0 and rows[1, 3].osmid == ["a", "b"]
    assert [p.x for p in rows[1, 3].geometry] == [0.0, 1.0, 2.0] and [(m.u, m.v) for m in rows[3, 1].merged_edges] == [(3, 2), (2, 1)]
    with pytest.raises(GraphSimplificationError):
        simplify.simplify_graph(out)


@pytest.mark.parametrize("limit, clusters, edges", [(None, 1, 0), (200.0, 1, 0), (50.0, 2, 1)])
def test_consolidate(spark, limit, clusters, edges):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0)], "osmid bigint, x double, y double")
    lines = spark.createDataFrame([(0, 1, 0, 1, "a", 100.0, None)], EDGES)
    out = simplify.consolidate_intersections(StreetGraph(nodes, lines, {"crs": 3857}), 1.0, limit)
    assert out.nodes.count() == clusters and out.edges.count() == edges


def test_consolidate_on_the_sphere(spark):
    # pairs 22 m apart west of Greenwich, far east on the equator, over longitude 180, over a zone border, in the south and at the pole
    step = 0.0002
    spots = [(-100.0, 0.0), (93.0, 0.0), (180.0 - step / 2, 0.0), (6.0 - step / 2, 10.0), (20.0, -60.0), (10.0, 89.9)]
    nodes, lines = [], []
    for i, (x, y) in enumerate(spots):
        x2 = x + step / math.cos(math.radians(y))
        nodes += [(10 * i, x, y), (10 * i + 1, x2 - 360 if x2 > 180 else x2, y), (10 * i + 2, x, y - 0.01)]
        lines += [(10 * i, 10 * i + 1, 0, 2 * i, "a", 22.0, None), (10 * i + 1, 10 * i + 2, 0, 2 * i + 1, "a", 1.0, None)]
    far = spark.createDataFrame(nodes, "osmid bigint, x double, y double")
    out = simplify.consolidate_intersections(StreetGraph(far, spark.createDataFrame(lines, EDGES)), 15.0, dead_ends=True)
    rows = {r.osmid: r for r in out.nodes.collect()}
    assert sorted(rows) == sorted([10 * i for i in range(6)] + [10 * i + 2 for i in range(6)])
    for i, (x, y) in enumerate(spots):
        got = rows[10 * i]
        assert got.osmid_original == [10 * i, 10 * i + 1] and got.y == pytest.approx(y, abs=1e-6)
        assert math.cos(math.radians(got.x - x - step / 2 / math.cos(math.radians(y)))) == pytest.approx(1, abs=1e-12)
    edges = {(r.u, r.v): r for r in out.edges.collect()}
    assert set(edges) == {(10 * i, 10 * i + 2) for i in range(6)}
    assert all(r.length == pytest.approx(1112 + 11, abs=2) and len(r.geometry) == 3 for r in edges.values())


def test_consolidate_drops_dead_ends(spark):
    # a triangle with a dead end 1 m from its first corner; the table has no street_count
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0), (2, 0.0, 100.0), (3, 1.0, 0.0)], "osmid bigint, x double, y double")
    lines = spark.createDataFrame([(a, b, 0, i, "a", 1.0, None) for i, (a, b) in enumerate([(0, 1), (1, 2), (2, 0), (0, 3), (3, 0)])], EDGES)
    graph = StreetGraph(nodes, lines, {"crs": 3857})
    out = simplify.consolidate_intersections(graph, 1.0, dead_ends=False)
    assert sorted(r.osmid_original for r in out.nodes.collect()) == [[0], [1], [2]] and out.edges.count() == 3
    assert {r.osmid: r.street_count for r in out.nodes.collect()} == {0: 3, 1: 2, 2: 2}
    kept = simplify.consolidate_intersections(graph, 1.0, dead_ends=True, reconnect=False)
    assert sorted(r.osmid_original for r in kept.nodes.collect()) == [[0, 3], [1], [2]]


def test_disc_union(spark):
    import numpy as np

    discs = [(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (0.5, 1.0, 0.7), (0.1, 0.1, 0.2), (1.0, 0.0, 0.5)]
    g = np.stack(np.meshgrid(np.linspace(-1.5, 2.5, 801), np.linspace(-1.5, 2.5, 801)), -1)
    inside = np.any([((g - (x, y)) ** 2).sum(-1) <= r * r for x, y, r in discs], 0)
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(discs)], "osmid bigint, x double, y double, reach double")
    lines = spark.createDataFrame([(0, 1, 0, 1, "a", 1.0, None)], EDGES)
    got = simplify.merged_places(StreetGraph(nodes, lines, {"crs": 3857}), "reach", dead_ends=True).collect()
    assert len(got) == 1 and got[0].n == 5 and (got[0].x, got[0].y) == pytest.approx(tuple(g[inside].mean(0)), abs=5e-3)


def test_own_tolerances_and_street_counts(spark):
    # 0 and 1 are 8 apart: their own reaches of 5 and 3 touch, 3 and null do not; the new node joins two streets
    rows = [(0, 0.0, 0.0, 5.0), (1, 8.0, 0.0, 3.0), (2, 50.0, 0.0, 3.0), (3, 55.0, 0.0, None)]
    nodes = spark.createDataFrame(rows, "osmid bigint, x double, y double, reach double")
    lines = spark.createDataFrame([(a, b, 0, i, "a", 1.0, None) for i, (a, b) in enumerate([(0, 1), (1, 0), (1, 2), (2, 3), (0, 3)])], EDGES)
    graph = StreetGraph(nodes, lines, {"crs": 3857})
    out = simplify.consolidate_intersections(graph, "reach", dead_ends=True)
    assert {r.osmid: (r.osmid_original, r.street_count) for r in out.nodes.collect()} == {0: ([0, 1], 2), 2: ([2], 2), 3: ([3], 2)}
    with pytest.raises(ValueError):
        simplify.consolidate_intersections(graph, 0.0)
    assert simplify.merged_places(graph.with_(nodes=nodes.limit(0)), 5.0, dead_ends=True).count() == 0


def test_streets_follow_their_lines(spark):
    pts = "geometry array<struct<x:double,y:double>>"
    bow = lambda y: [(0.0, 0.0), (0.5, y), (1.0, 0.0)]
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "osmid bigint, x double, y double")
    rows = [(1, 2, 0, 1, "a", 1.0, None, None), (2, 1, 0, 2, "a", 1.0, None, [(1.0, 0.0), (0.0, 0.0)]),  # one street, drawn and undrawn
            (1, 2, 1, 3, "b", 1.2, None, bow(0.4)), (2, 1, 1, 4, "b", 1.2, None, bow(-0.4)[::-1]),  # two streets that bow apart under one key
            (1, 2, 3, 5, "a", 1.0, None, None),  # the first street again under another key: same way and line
            (1, 2, 4, 6, "c", 1.0, None, None), (2, 2, 0, 7, "d", 1.0, None, bow(1.0)), (2, 2, 1, 8, "d", 1.0, None, bow(1.0)[::-1])]
    edges = spark.createDataFrame(rows, EDGES + ", " + pts)
    got = {(r.u, r.v, r.key): r.ord for r in convert.to_undirected(StreetGraph(nodes, edges)).collect()}
    assert got == {(1, 2, 0): 1, (1, 2, 5): 3, (1, 2, 1): 4, (1, 2, 4): 6, (2, 2, 0): 7}
    listed = edges.withColumn("osmid", F.when(F.col("ord") == 5, F.array(F.lit("z"), F.lit("a"))).otherwise(F.array("osmid")))
    assert convert.to_undirected(StreetGraph(nodes, listed)).count() == 6 and convert.to_undirected(StreetGraph(nodes, edges.limit(0))).count() == 0
    row = stats.basic_stats(StreetGraph(nodes, edges), area=1e6, clean_int_tol=10.0).first()
    assert (row.n, row.m, row.street_segment_count, row.clean_intersection_count) == (2, 8, 5, 2) and row.streets_per_node_counts[4] == 1


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2, 0, 1, "a", 1.0, None), (2, 3, 0, 2, "a", 1.0, None), (1, 3, 0, 3, "a", 5.0, None), (1, 3, 1, 4, "a", 2.5, None), (4, 4, 0, 5, "a", 1.0, None)], EDGES)
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "osmid bigint")
    pairs = spark.createDataFrame([(1, 1, 3), (2, 3, 1), (3, 1, None)], "route_id bigint, orig bigint, dest bigint")
    got = {(r.route_id, r["rank"]): (r.cost, r.nodes) for r in paths.shortest_paths(pairs, edges, k=3).collect()}
    assert got == {(1, 1): (2.0, [1, 2, 3]), (1, 2): (2.5, [1, 3]), (2, 1): (None, None), (3, 1): (None, None)}
    assert {tuple(r) for r in paths.distances_from(edges, 1).collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}
    assert {tuple(r) for r in paths.weak_components(nodes, edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    loop = edges.unionByName(spark.createDataFrame([(3, 1, 0, 9, "a", 1.0, None)], EDGES))
    assert {tuple(r) for r in paths.strong_components(nodes, loop).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert {(r.u, r.v, r.key) for r in convert.to_digraph(edges).collect()} == {(1, 2, 0), (2, 3, 0), (1, 3, 1), (4, 4, 0)}


def test_strong_components_in_tasks_and_by_rounds(spark, monkeypatch):
    import random

    rng = random.Random(4)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(110)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 201), (300, 300)]
    edges = spark.createDataFrame(pairs, "u bigint, v bigint")
    nodes = spark.createDataFrame([(i,) for i in {x for p in pairs for x in p} | {400}], "osmid bigint")
    after = {}
    for u, v in pairs:
        after.setdefault(u, set()).add(v)

    def reach(x):
        seen, stack = {x}, [x]
        while stack:
            for y in after.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        return seen

    far = {r.osmid: reach(r.osmid) for r in nodes.collect()}
    want = {x: min(y for y in far[x] if x in far[y]) for x in far}
    assert {r.osmid: r.component for r in paths.strong_components(nodes, edges).collect()} == want
    monkeypatch.setattr(paths, "PIECE_EDGES", 20)  # the random piece goes through the rounds, the ring stays in a task
    monkeypatch.setattr(paths, "TASK_EDGES", 5)
    assert {r.osmid: r.component for r in paths.strong_components(nodes, edges).collect()} == want
    assert paths.strong_components(nodes.limit(0), edges.limit(0)).count() == 0


def test_routes_beyond_the_index(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(rng.randint(0, 25), rng.randint(0, 25), 0, i, "a", rng.random() + 0.1, None) for i in range(70)]
    edges = spark.createDataFrame(rows, EDGES)
    pairs = spark.createDataFrame([(i, i % 4, rng.randint(0, 30)) for i in range(40)] + [(50, None, 1), (51, 1, None), (52, 99, 1)], "route_id bigint, orig bigint, dest bigint")
    want = {r.route_id: (r.cost, r.nodes) for r in paths.shortest_paths(pairs, edges).collect()}
    monkeypatch.setattr(paths, "MAX_INDEX_EDGES", 0)
    got = {r.route_id: (r.cost, r.nodes) for r in paths.shortest_paths(pairs, edges).collect()}
    assert set(got) == set(want)
    for route, (cost, path) in want.items():
        assert got[route] == (cost if cost is None else pytest.approx(cost), path)
    with pytest.raises(ValueError):
        paths.shortest_paths(pairs, edges, k=2)


def test_route_lines_and_feature_rules(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0)], "osmid bigint, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0, 1, "a", 1.0, None, [(0.0, 0.0), (0.5, 0.5), (1.0, 0.0)]), (2, 3, 0, 2, "a", 1.0, None, None), (2, 3, 1, 3, "a", 0.5, None, [(1.0, 0.0), (1.5, 1.0), (2.0, 0.0)])],
                                  EDGES + ", geometry array<struct<x:double,y:double>>")
    routes = spark.createDataFrame([(7, [1, 2, 3]), (8, [2, 3]), (9, None), (10, [1])], "route_id bigint, nodes array<bigint>")
    got = {r.route_id: [(p.x, p.y) for p in r.line] for r in convert.route_lines(routes, StreetGraph(nodes, edges)).collect()}
    assert got == {7: [(0.0, 0.0), (0.5, 0.5), (1.0, 0.0), (1.5, 1.0), (2.0, 0.0)], 8: [(1.0, 0.0), (1.5, 1.0), (2.0, 0.0)]}
    rows = spark.createDataFrame([("node", 1, {"a": "b"}), ("node", 1, {"a": "b"}), ("area", None, {}), (None, 2, None)], "element string, id bigint, tags map<string,string>")
    assert {r.rule: r.violations for r in convert.validate_features(rows).collect()} == {"element_unknown": 2, "feature_without_id": 1, "feature_without_tags": 2, "feature_repeated": 1}


def test_exact_quantiles(spark):
    from roadframe.operators.attributes import exact_quantiles

    rows = spark.range(0, 1001).selectExpr("CASE WHEN id % 3 = 0 THEN 5.0 ELSE CAST(id AS double) END AS v", "id")
    values = sorted(5.0 if i % 3 == 0 else float(i) for i in range(1001))
    want = [values[int(1000 * s)] + (values[min(int(1000 * s) + 1, 1000)] - values[int(1000 * s)]) * (1000 * s % 1) for s in (0.1, 0.25, 0.5, 0.9995)]
    assert exact_quantiles(rows, "v", [0.1, 0.25, 0.5, 0.9995]) == pytest.approx(want)
    assert exact_quantiles(rows.limit(0), "v", [0.5]) == [None]


def test_intermediates_can_be_released(spark):
    import os

    from roadframe.session import materialize, release, run_dir

    kept = materialize(spark.range(5), "x")
    place = run_dir(spark)
    assert kept.count() == 5 and os.path.isdir(place)
    release(spark)
    assert not os.path.exists(place) and materialize(spark.range(3), "x").count() == 3


def test_paths_from_one_tree():
    import numpy as np

    rng = np.random.default_rng(3)
    pairs = np.array(sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (90, 2)) if a != b}))
    index = paths._Index(pairs[:, 0], pairs[:, 1], rng.random(len(pairs)))
    for s in (0, 5):
        tree = index.tree(s)
        for t in range(len(index.ids)):
            want, got = list(index.k_best(s, t, 4)), list(index.from_tree(s, t, 4, *tree))
            assert [p for _, p in got] == [p for _, p in want] and [c for c, _ in got] == pytest.approx([c for c, _ in want])


def write_graph(spark, folder, nodes, edges):
    """Tables ``nodes`` and ``edges`` of a small graph from (osmid, x, y) and (u, v, key, length, geom_wkt)."""
    spark.createDataFrame([(*n, None, None) for n in nodes], "osmid bigint, x double, y double, elevation double, highway string").write.parquet(f"{folder}/nodes.parquet")
    rows = [(i, *e[:3], "1", None, None, False, False, *e[3:]) for i, e in enumerate(edges)]
    spark.createDataFrame(rows, "ord bigint, u bigint, v bigint, key int, osmid string, highway string, maxspeed string, oneway boolean, reversed boolean, length double, geom_wkt string").write.parquet(f"{folder}/edges.parquet")
    return str(folder)


def test_every_node_gets_its_answer(spark, tmp_path):
    d = write_graph(spark, tmp_path, [(i, 0.001 * i, 0.0) for i in range(1, 6)], [(1, 2, 0, 1.0, None), (1, 3, 0, 5.0, None), (1, 4, 0, 1.0, None), (2, 3, 0, 1.0, None)])
    assert {tuple(r) for r in network.shortest_path(spark, d).collect()} == {(1, 0.0), (2, 1.0), (3, 2.0), (4, 1.0), (5, None)}
    assert {tuple(r) for r in network.route_edges(spark, d).collect()} == {(2, 1.0, True), (3, 2.0, True), (4, 1.0, True)}
    got = {(r.route_id, r["rank"]): (r.cost, r.n_nodes) for r in network.k_shortest_paths(spark, d).collect()}
    assert got == {(1, 1): (0.0, 1), (2, 1): (1.0, 2), (3, 1): (2.0, 3), (3, 2): (5.0, 2), (4, 1): (1.0, 2), (5, 1): (None, got[5, 1][1])}
    assert {r.point_id for r in network.nearest_nodes(spark, d).collect()} == {1, 2, 3, 4, 5}


def test_bent_edges(spark, tmp_path):
    # the edge runs over (0.02, 0.03), past the third node; its ends' straight line is far from there
    d = write_graph(spark, tmp_path, [(1, 0.0, 0.0), (2, 0.04, 0.0), (3, 0.0193, 0.0304)], [(1, 2, 0, 1.0, "LINESTRING (0 0, 0.02 0.03, 0.04 0)"), (2, 1, 0, 1.0, None)])
    got = {r.point_id: r.dist for r in network.nearest_edges(spark, d).collect()}

    def away(x, y, line):
        at = [(ax + (bx - ax) * k / 5000, ay + (by - ay) * k / 5000) for (ax, ay), (bx, by) in zip(line, line[1:]) for k in range(5001)]
        return min(math.hypot(x - a, y - b) for a, b in at)

    for i, x, y in [(1, 0.0007, -0.0004), (2, 0.0407, -0.0004), (3, 0.02, 0.03)]:
        assert got[i] == pytest.approx(min(away(x, y, [(0, 0), (0.02, 0.03), (0.04, 0)]), away(x, y, [(0, 0), (0.04, 0)])), abs=1e-6)
    assert {(r.u, r.v): r.n_points for r in network.interpolate_points(spark, d).collect()} == {(1, 2): 8, (2, 1): 5}


def test_nearest(spark):
    nodes = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(49)], "osmid bigint, x double, y double")
    points = spark.createDataFrame([(1, 2.2, 3.3), (2, 100.0, 100.0), (3, None, 1.0)], "point_id bigint, x double, y double")
    got = {r.point_id: r.osmid for r in nearest.nearest_nodes(nodes, points, projected=True, cell=0.5).collect()}
    assert got == {1: 23, 2: 48, 3: None}


def test_text_of_every_part(spark, tmp_path):
    box = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, a))]
    rows = spark.createDataFrame([(1, [[box(0, 9), box(1, 2)], [box(20, 21)]]), (2, [[box(3, 4)]])], "area_id int, polygons array<array<array<struct<x:double,y:double>>>>")
    rows.write.parquet(f"{tmp_path}/areas.parquet")
    got = {(r.area_id, r.part): r.place for r in network.polygon_texts(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)} and got[1, 2].startswith("20.000000 20.000000 20.000000 21.000000 ") and "2.000000 2.000000" not in got[1, 1]


def test_island_in_hole():
    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    parts = assemble_multipolygon([box(0, 10), box(4, 6)], [box(2, 8)])
    assert multipolygon_wkt(parts) == ("MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2)), ((4 4, 6 4, 6 6, 4 6, 4 4)))")
    half = [(0, 0), (1, 0), (1, 1)], [(0, 0), (0, 1), (1, 1)]
    assert len(assemble_multipolygon(list(half), [])) == 1


def test_features_meet_polygon(spark):
    shape = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]]
    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    lines = {1: [(-5, 5), (-1, 5)], 2: [(-5, 5), (20, 5)], 3: [(1, 1), (2, 2)], 4: [(4.5, 5), (5.5, 5)], 5: [(10, 3), (12, 3)], 6: [(-1, 9), (1, 11.5)], 7: [(-1, 9), (1, 10.5)], 8: box(-1, 11), 9: box(-1, 11), 10: box(4.2, 5.8), 11: box(20, 30), 12: box(-2, 12), 13: box(-1.5, 11.5)}
    areas, pts = {9, 10, 11}, "array<struct<x:double,y:double>>"
    rows = [(i, {} if i in (12, 13) else {"building": "yes"}, "Polygon" if i in areas else "LineString", [(float(x), float(y)) for x, y in p]) for i, p in lines.items()]
    ways = spark.createDataFrame(rows, f"id bigint, tags map<string,string>, kind string, points {pts}")
    made = lambda i, *refs, **tags: (i, [("way", r, role) for r, role in refs], {"type": "multipolygon", **tags})
    rels = [made(1, (12, "outer"), landuse="x"), made(2, (12, "outer"), (13, "inner"), landuse="x"), made(3, (11, "outer"), landuse="x"), made(4, (12, "outer")), made(5, (99, "outer"), landuse="x")]
    relations = spark.createDataFrame(rels, "id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>")
    points = spark.createDataFrame([(1, 1.0, 1.0, {"building": "a"}), (2, 5.0, 5.0, {"building": "a"}), (3, 4.0, 5.0, {"building": "a"}), (4, 1.0, 1.0, {"shop": "a"})], "id bigint, x double, y double, tags map<string,string>")
    got = features.features_meeting_polygon(points, ways, relations, shape, {"building": True, "landuse": True}).collect()
    assert {(r.element, r.id) for r in got} == {("node", 1), ("node", 3), ("way", 2), ("way", 3), ("way", 5), ("way", 7), ("way", 9), ("relation", 1)}


def test_chain_nodes():
    assert chain_nodes([(2, 3), (1, 2), (3, 4)]) == [1, 2, 3, 4]
    assert chain_nodes([(1, 2), (2, 3), (3, 1)]) == [1, 2, 3, 1]
