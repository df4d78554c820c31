"""Topology: endpoints, chain contraction, rings, consolidation of intersections."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadframe.functions.cells import sphere_xyz
from roadframe.functions.geo import great_circle, line_length
from roadframe.model import EARTH_RADIUS_M, GraphSimplificationError, StreetGraph
from roadframe.operators.convert import edge_points
from roadframe.operators.paths import weak_components
from roadframe.operators.proximity import near_pairs
from roadframe.operators.stats import count_streets_per_node
from roadframe.session import materialize


def known(rows: DataFrame, column: str) -> Column:
    """The column with NaN read as missing."""
    return F.when(~F.isnan(column), F.col(column)) if dict(rows.dtypes)[column] in ("double", "float") else F.col(column)


def endpoints(nodes: DataFrame, edges: DataFrame, node_attrs: Iterable[str] = (), edge_attrs: Iterable[str] = ()) -> DataFrame:
    """``(osmid, is_endpoint)`` from one aggregation over incident edges.

    An endpoint loops to itself, lacks an edge in or out, does not merely pass
    from one neighbour to another (two neighbours, two or four edge ends), carries
    one of ``node_attrs``, or joins edges that differ in one of ``edge_attrs``
    (null and NaN are one value).
    """
    edge_attrs, node_attrs = list(edge_attrs), list(node_attrs)
    keep = [F.coalesce(known(edges, a).cast("string"), F.lit("\0")).alias(f"_{a}") for a in edge_attrs]
    out = edges.select(F.col("u").alias("osmid"), F.col("v").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"), *keep)
    back = edges.select(F.col("v").alias("osmid"), F.col("u").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i"), *keep)
    differ = [(F.min(f"_{a}") != F.max(f"_{a}")).alias(f"d_{a}") for a in edge_attrs]
    # a node with two neighbours is told by its smallest and largest one: no set of neighbours is collected
    rows = out.unionByName(back)
    s = rows.groupBy("osmid").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.min("other").alias("lo"), F.max("other").alias("hi"),
                                  F.bool_or(F.col("other") == F.col("osmid")).alias("loop"), *differ)
    mid = rows.join(s.where("o + i IN (2, 4)").select("osmid", "lo", "hi"), "osmid").where("other <> lo AND other <> hi").select("osmid").distinct().withColumn("third", F.lit(True))
    d = F.col("o") + F.col("i")
    passing = (F.col("lo") != F.col("hi")) & F.col("third").isNull() & d.isin(2, 4)
    tagged = F.lit(False)
    for a in node_attrs:
        tagged = tagged | known(nodes, a).isNotNull()
    test = F.coalesce(F.col("loop") | (F.col("o") == 0) | (F.col("i") == 0) | ~passing, F.lit(True))
    for a in edge_attrs:
        test = test | F.coalesce(F.col(f"d_{a}"), F.lit(False))
    return nodes.select("osmid", *node_attrs).join(s, "osmid", "left").join(mid, "osmid", "left").select("osmid", (test | tagged).alias("is_endpoint"))


def chains(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``(chain, hop, u, v, key)``: the edges between two endpoints in walking order.

    A chain is named by its first edge's rank-free identity ``(u, v, key)`` packed in ``chain``.
    Every edge points to the one that continues it past a passing node; pointers
    and hop counts double until all chains of endpoints are complete, so a chain of
    n edges takes log2(n) rounds.
    """
    flags = materialize(ends, "ends")
    first = edges.groupBy("u", "v").agg(F.min("key").alias("key"))  # of parallel edges on a passing node the first speaks
    tail = flags.select(F.col("osmid").alias("u"), F.col("is_endpoint").alias("tail_end"))
    head = flags.select(F.col("osmid").alias("v"), F.col("is_endpoint").alias("head_end"))
    marked = edges.select("u", "v", "key").join(tail, "u").join(head, "v")
    plain = marked.where("tail_end AND head_end").select(F.struct("u", "v", "key").alias("chain"), F.lit(0).alias("hop"), "u", "v", "key")
    inner = materialize(marked.join(first, ["u", "v", "key"], "left_semi").where("NOT (tail_end AND head_end)"), "inner")
    # the edge before each edge: enters its tail from elsewhere, and the tail is no endpoint
    nxt = inner.where("NOT tail_end").select(F.col("u").alias("mid"), F.col("v").alias("to"))
    hops = inner.where("NOT head_end").join(nxt, F.col("v") == F.col("mid")).where("u <> to").select(
        F.struct(F.col("mid").alias("u"), F.col("to").alias("v")).alias("e"), F.struct("u", "v").alias("p"))
    pointers = inner.select(F.struct("u", "v").alias("e"), "tail_end").join(hops, "e", "left").select(
        "e", F.when(F.col("tail_end"), F.col("e")).otherwise(F.col("p")).alias("p"), F.when(F.col("tail_end"), 0).otherwise(1).alias("hop"), F.col("tail_end").alias("rooted"))
    # a broken or endless chain has no root and is left to the ring rules
    pointers = materialize(pointers.where("p IS NOT NULL"), "pointers")
    open_before = -1
    while True:
        left = pointers.where("NOT rooted").count()
        if left == 0 or left == open_before:
            break
        open_before = left
        far = pointers.select(F.col("e").alias("p"), F.col("p").alias("p2"), F.col("hop").alias("h2"), F.col("rooted").alias("r2"))
        pointers = materialize(pointers.join(far, "p", "left").select(
            "e", F.when(F.col("rooted"), F.col("p")).otherwise(F.coalesce("p2", "p")).alias("p"),
            F.when(F.col("rooted"), F.col("hop")).otherwise(F.col("hop") + F.coalesce("h2", F.lit(0))).alias("hop"),
            (F.col("rooted") | F.coalesce("r2", F.lit(False))).alias("rooted")), "pointers")
    rooted = pointers.where("rooted").select(F.col("e.u").alias("u"), F.col("e.v").alias("v"), "p", "hop")
    keyed = rooted.join(inner.select("u", "v", "key"), ["u", "v"])
    roots = inner.where("tail_end").select(F.struct("u", "v").alias("p"), F.struct("u", "v", "key").alias("chain"))
    walked = keyed.join(roots, "p").select("chain", "hop", "u", "v", "key")
    return plain.unionByName(walked)


def simplify_graph(graph: StreetGraph, node_attrs: Iterable[str] = (), edge_attrs: Iterable[str] = (), remove_rings: bool = True,
                   track_merged: bool = False, aggs: dict[str, Callable[[Column], Column]] | None = None) -> StreetGraph:
    """Chains between endpoints become single edges; passing nodes go.

    ``length`` and ``travel_time`` add up; other columns become the sorted list of
    their distinct values; ``aggs`` overrides per column. The new ``geometry``
    follows the nodes; with ``track_merged`` the merged (u, v) pairs are kept in order.
    """
    if graph.attrs.get("simplified"):
        raise GraphSimplificationError("this graph has been simplified already")
    ends = materialize(endpoints(graph.nodes, graph.edges, node_attrs, edge_attrs), "ends")
    steps = materialize(chains(graph.edges, ends), "chains")
    rest = [c for c in graph.edges.columns if c not in ("u", "v", "key", "ord", "geometry")]
    aggs = {"length": F.sum, "travel_time": F.sum} | (aggs or {})
    # a chain's nodes in order: its length is a street's, not the graph's
    rows = steps.join(graph.edges.select("u", "v", "key", *rest), ["u", "v", "key"])
    coordinates = graph.nodes.select(F.col("osmid").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    rows = rows.join(coordinates, "v", "left")
    columns = [(aggs[c](known(graph.edges, c)) if c in aggs else F.array_sort(F.collect_set(known(graph.edges, c)))).alias(c) for c in rest]
    path = F.array_sort(F.collect_list(F.struct("hop", "u", "v", "vx", "vy")))
    out = rows.groupBy("chain").agg(*columns, path.alias("_p"))
    start = graph.nodes.select(F.col("osmid").alias("_u"), F.struct("x", "y").alias("_start"))
    out = out.withColumn("_u", F.col("chain.u")).join(start, "_u", "left")
    out = out.withColumn("geometry", F.when(F.size("_p") > 1, F.concat(F.array("_start"), F.transform("_p", lambda s: F.struct(s["vx"].alias("x"), s["vy"].alias("y"))))))
    if track_merged:
        out = out.withColumn("merged_edges", F.transform("_p", lambda s: F.struct(s["u"].alias("u"), s["v"].alias("v"))))
    number = F.row_number().over(Window.partitionBy("u", "v").orderBy("chain.v", "chain.key")) - 1
    edges = out.withColumn("u", F.col("chain.u")).withColumn("v", F.element_at("_p", -1)["v"]).withColumn("key", number.cast("int"))
    edges = edges.select("u", "v", "key", *rest, "geometry", *(["merged_edges"] if track_merged else []))
    # a walk that finds no way on ends where it stops, so that node stays too
    stops = ends.where("is_endpoint").select("osmid").unionByName(edges.select(F.col("v").alias("osmid"))).distinct()
    nodes = graph.nodes.join(stops, "osmid", "left_semi")
    if not remove_rings:  # keep components without any endpoint as they were
        labels = weak_components(graph.nodes, graph.edges)
        ringed = materialize(labels.join(ends, "osmid").groupBy("component").agg(F.bool_or("is_endpoint").alias("e")).where("NOT e"), "rings")
        ring_nodes = labels.join(ringed, "component", "left_semi").select("osmid")
        nodes = nodes.unionByName(graph.nodes.join(ring_nodes, "osmid", "left_semi"))
        kept = graph.edges.join(ring_nodes.withColumnRenamed("osmid", "u"), "u", "left_semi")
        same = [F.col(c).alias(c) if c in aggs else F.array(F.col(c)).alias(c) for c in rest]
        ring_edges = kept.select("u", "v", "key", *same, F.lit(None).cast("array<struct<x:double,y:double>>").alias("geometry"))
        if track_merged:
            ring_edges = ring_edges.withColumn("merged_edges", F.array(F.struct("u", "v")))
        edges = edges.unionByName(ring_edges)
    return graph.with_(nodes=nodes, edges=edges, attrs={**graph.attrs, "simplified": True})


def touching_pairs(nodes: DataFrame, flat: bool, reach: float) -> DataFrame:
    """``(a, b)``, a < b: nodes ``(osmid, x, y, r)`` whose discs of radius ``r`` (at most ``reach``) touch.

    Measured in the plane when ``flat``, else in metres on the sphere, so that no zone, pole or longitude 180 cuts a pair.
    """
    places = lambda i: nodes.select(F.col("osmid").alias(i), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), F.col("r").alias(f"r{i}"))
    if not flat:
        near = near_pairs(nodes, max(2.0 * reach, 1e-6)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        both = near.join(places("a"), "a").join(places("b"), "b")
        return both.where(great_circle(F.col("ya"), F.col("xa"), F.col("yb"), F.col("xb")) <= F.col("ra") + F.col("rb")).select("a", "b")
    size = max(2.0 * reach, 1e-9)
    placed = places("a").withColumn("i", F.floor(F.col("xa") / size)).withColumn("j", F.floor(F.col("ya") / size))
    around = F.explode(F.flatten(F.array(*[F.array(*[F.struct((F.floor(F.col("xb") / size) + p).alias("i"), (F.floor(F.col("yb") / size) + q).alias("j")) for q in (-1, 0, 1)]) for p in (-1, 0, 1)])))
    probe = places("b").withColumn("_c", around).select("b", "xb", "yb", "rb", "_c.i", "_c.j")
    d2 = (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb"))
    return placed.join(probe, ["i", "j"]).where((F.col("a") < F.col("b")) & (d2 <= (F.col("ra") + F.col("rb")) * (F.col("ra") + F.col("rb")))).select("a", "b")


def disc_arcs(x: float, y: float, r: float, others: np.ndarray) -> tuple[float, float, float]:
    """What one disc's free boundary adds to area and first moments of a union; ``others`` has a row (x, y, r) per disc that touches it."""
    if r <= 0:
        return 0.0, 0.0, 0.0
    d, ro = others[:, :2] - (x, y), others[:, 2]
    gap = np.hypot(d[:, 0], d[:, 1])
    if (gap + r <= ro).any():
        return 0.0, 0.0, 0.0
    cut = (gap < r + ro) & (gap + ro > r)
    mid, half = np.arctan2(d[cut, 1], d[cut, 0]), np.arccos(np.clip((r * r + gap[cut] ** 2 - ro[cut] ** 2) / (2 * r * gap[cut]), -1, 1))
    spans = [(0.0, 2 * np.pi)]
    for lo, hi in zip((mid - half) % (2 * np.pi), (mid - half) % (2 * np.pi) + 2 * half):
        for a, b in [(lo, hi)] if hi <= 2 * np.pi else [(lo, 2 * np.pi), (0.0, hi - 2 * np.pi)]:
            spans = [s for p, q in spans for s in ((p, min(q, a)), (max(p, b), q)) if s[1] - s[0] > 1e-15]
    area = mx = my = 0.0
    for a, b in spans:
        s, c, w = np.sin(b) - np.sin(a), np.cos(b) - np.cos(a), b - a
        area += 0.5 * r * (x * s - y * c + r * w)
        s2, s3 = (np.sin(2 * b) - np.sin(2 * a)) / 2, (np.sin(b) ** 3 - np.sin(a) ** 3) / 3
        c3 = (np.cos(b) ** 3 - np.cos(a) ** 3) / 3
        mx += 0.5 * r * (x * x * s + x * r * (w + s2) + r * r * (s - s3))
        my += 0.5 * r * (-y * y * c + y * r * (w - s2) + r * r * (-c + c3))
    return float(area), float(mx), float(my)


def _on_plane(places: DataFrame, key: str, flat: bool) -> tuple[DataFrame, DataFrame]:
    """Places with ``px, py`` on the plane of their group, and per group what leads back from there.

    A flat group is moved to its mean. On the sphere the plane touches amid the group, and distances from there are true (metres).
    """
    if flat:
        back = places.groupBy(key).agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"))
        return places.join(back, key).withColumn("px", F.col("x") - F.col("ox")).withColumn("py", F.col("y") - F.col("oy")).drop("ox", "oy"), back
    vx, vy, vz = sphere_xyz(F.col("x"), F.col("y"), 1.0)
    placed = places.withColumns({"vx": vx, "vy": vy, "vz": vz})
    mean = placed.groupBy(key).agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in "xyz"])
    size = F.sqrt(sum(F.col(f"m{i}") * F.col(f"m{i}") for i in "xyz"))
    mean = mean.withColumns({f"c{i}": F.col(f"m{i}") / size for i in "xyz"})
    level = F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))
    pole = level <= 1e-12
    mean = mean.withColumns({"ex": F.when(pole, 0.0).otherwise(-F.col("cy") / F.greatest(level, F.lit(1e-300))), "ey": F.when(pole, 1.0).otherwise(F.col("cx") / F.greatest(level, F.lit(1e-300)))})
    mean = mean.withColumns({"nx": -F.col("cz") * F.col("ey"), "ny": F.col("cz") * F.col("ex"), "nz": F.col("cx") * F.col("ey") - F.col("cy") * F.col("ex")})
    back = mean.select(key, "cx", "cy", "cz", "ex", "ey", "nx", "ny", "nz")
    both = placed.join(back, key)
    east = F.col("vx") * F.col("ex") + F.col("vy") * F.col("ey")
    north = F.col("vx") * F.col("nx") + F.col("vy") * F.col("ny") + F.col("vz") * F.col("nz")
    up = F.col("vx") * F.col("cx") + F.col("vy") * F.col("cy") + F.col("vz") * F.col("cz")
    away = F.sqrt(east * east + north * north)
    scale = F.when(away > 0, EARTH_RADIUS_M * F.atan2(away, up) / F.greatest(away, F.lit(1e-300))).otherwise(EARTH_RADIUS_M)
    return both.withColumn("px", east * scale).withColumn("py", north * scale).select(*places.columns, "px", "py"), back


def _off_plane(found: DataFrame, back: DataFrame, key: str, flat: bool) -> DataFrame:
    """Coordinates ``x, y`` of rows ``(..., px, py)`` on their group's plane."""
    rows = found.join(back, key)
    if flat:
        return rows.withColumn("x", F.col("ox") + F.col("px")).withColumn("y", F.col("oy") + F.col("py"))
    angle = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")) / EARTH_RADIUS_M
    ratio = F.when(angle > 0, F.sin(angle) / F.greatest(angle, F.lit(1e-300))).otherwise(1.0) / EARTH_RADIUS_M
    w = {i: F.cos(angle) * F.col(f"c{i}") + ratio * (F.col("px") * (F.col(f"e{i}") if i != "z" else F.lit(0.0)) + F.col("py") * F.col(f"n{i}")) for i in "xyz"}
    return rows.withColumn("x", F.degrees(F.atan2(w["y"], w["x"]))).withColumn("y", F.degrees(F.atan2(w["z"], F.sqrt(w["x"] * w["x"] + w["y"] * w["y"]))))


def group_centres(placed: DataFrame, pairs: DataFrame, flat: bool) -> DataFrame:
    """``(part, x, y)``: where the groups of rows ``(osmid, x, y, r, cluster, part)`` lie.

    A cluster in one part lies at the area centroid of the union of its discs: every disc adds the arcs that no disc
    touching it covers, so a task sees one disc and its neighbours, never a whole cluster. A part of a split cluster
    lies at the mean of its places. Nodes at one place count once.
    """
    # of nodes at one place the one with the widest disc speaks
    spot = placed.groupBy("cluster", "part", "x", "y").agg(F.max_by(F.struct("osmid", "r"), F.struct("r", "osmid")).alias("_s")).select("cluster", "part", "x", "y", "_s.osmid", "_s.r")
    spot = materialize(spot, "spots")
    sizes = spot.groupBy("cluster").agg(F.count(F.lit(1)).alias("spots"), (F.min("part") != F.max("part")).alias("split"))
    parts = spot.groupBy("part").agg(F.count(F.lit(1)).alias("own"))
    sized = spot.join(sizes, "cluster").join(parts, "part")
    alone = sized.where("own = 1 AND (split OR spots = 1)").select("part", "x", "y")
    several = sized.where("NOT (own = 1 AND (split OR spots = 1))").drop("own", "spots")
    plane, back = _on_plane(several, "part", flat)
    plane = materialize(plane, "plane")
    means = plane.groupBy("part").agg(F.avg("px").alias("ax"), F.avg("py").alias("ay"))
    whole = plane.where("NOT split")
    end = lambda i: whole.select(F.col("osmid").alias(i), F.struct("px", "py", "r").alias(f"d{i}"), F.col("part").alias(f"p{i}"))
    linked = pairs.join(end("a"), "a").join(end("b"), "b").where("pa = pb")
    near = linked.select(F.explode(F.array(F.struct(F.col("a").alias("osmid"), F.col("db").alias("d")), F.struct(F.col("b").alias("osmid"), F.col("da").alias("d")))).alias("_n"))
    lists = near.select("_n.*").groupBy("osmid").agg(F.collect_list("d").alias("around"))  # the discs that touch one disc
    listed = whole.join(lists, "osmid", "left").select("part", "px", "py", "r", "around")

    def arcs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for part, x, y, r, around in batch.itertuples(index=False):
                others = np.array([(o["px"], o["py"], o["r"]) for o in (around if around is not None else [])], float).reshape(-1, 3)
                rows.append((part, *disc_arcs(x, y, r, others)))
            yield pd.DataFrame(rows, columns=["part", "area", "mx", "my"])

    sums = listed.mapInPandas(arcs, "part bigint, area double, mx double, my double").groupBy("part").agg(F.sum("area").alias("area"), F.sum("mx").alias("mx"), F.sum("my").alias("my"))
    found = means.join(sums, "part", "left").select("part", F.when(F.col("area") > 0, F.col("mx") / F.col("area")).otherwise(F.col("ax")).alias("px"),
                                                    F.when(F.col("area") > 0, F.col("my") / F.col("area")).otherwise(F.col("ay")).alias("py"))
    return alone.unionByName(_off_plane(found, back, "part", flat).select("part", "x", "y"))


def _street_nodes(graph: StreetGraph, tolerance: float | str, dead_ends: bool | None) -> tuple[DataFrame, float]:
    """Nodes to consolidate with their radius ``r``, and the largest radius."""
    nodes = graph.nodes
    radius = F.lit(float(tolerance)) if not isinstance(tolerance, str) else F.coalesce(F.col(tolerance).cast("double"), F.lit(0.0))
    if isinstance(tolerance, str):
        low, reach = nodes.agg(F.min(tolerance), F.max(tolerance)).first()
        low, reach = (None if v is None else float(v) for v in (low, reach))
    else:
        low = reach = float(tolerance)
    if low is not None and low <= 0:
        raise ValueError("the tolerance must be positive")
    if dead_ends is False and "street_count" not in nodes.columns:
        nodes = nodes.join(count_streets_per_node(nodes, graph.edges), "osmid")
    if not dead_ends and "street_count" in nodes.columns:
        nodes = nodes.where("street_count > 1")
    return nodes.withColumn("r", radius), reach or 0.0


def merged_places(graph: StreetGraph, tolerance: float | str = 10.0, dead_ends: bool | None = None) -> DataFrame:
    """``(cluster, n, x, y)``: centroids of merged intersections by place alone, without rebuilding the graph."""
    nodes, reach = _street_nodes(graph, tolerance, dead_ends)
    nodes = materialize(nodes.select("osmid", "x", "y", "r"), "nodes")
    pairs = materialize(touching_pairs(nodes, graph.projected, reach), "pairs")
    labels = weak_components(nodes, pairs.toDF("u", "v")).withColumnRenamed("component", "cluster")
    placed = materialize(nodes.join(labels, "osmid").withColumn("part", F.col("cluster")), "clusters")
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return group_centres(placed, pairs, graph.projected).withColumnRenamed("part", "cluster").join(sizes, "cluster").select("cluster", "n", "x", "y")


def consolidate_intersections(graph: StreetGraph, tolerance: float | str = 10.0, max_length: float | None = None, dead_ends: bool | None = None,
                              reconnect: bool = True, aggs: dict[str, Callable[[Column], Column]] | None = None) -> StreetGraph:
    """Nodes whose discs of radius ``tolerance`` touch become one node; a text names a node column with each node's own (null: none).

    Projected graphs are measured in their plane. Others are measured in metres on the sphere; a cluster's place is
    found on the plane that touches the sphere there. Nodes of at most one street are dropped when ``dead_ends`` is
    False: by their ``street_count``, or counted here when there is no such column. None drops them only where the
    column is there; True keeps them. A cluster whose nodes are not all linked inside it (edges over ``max_length``
    do not link) is split into its linked parts. New nodes list their ``osmid_original``; a node made of one keeps its
    ``street_count``, others get theirs from the new edges. ``merged_places`` gives the clusters' places alone.
    """
    if graph.attrs.get("consolidated"):
        raise GraphSimplificationError("this graph has been consolidated already")
    nodes, reach = _street_nodes(graph, tolerance, dead_ends)
    flat = graph.projected
    bare = materialize(nodes.select("osmid", "x", "y", "r"), "nodes")
    pairs = materialize(touching_pairs(bare, flat, reach), "pairs")
    placed = materialize(bare.join(weak_components(bare, pairs.toDF("u", "v")).withColumnRenamed("component", "cluster"), "osmid"), "clusters")
    side = lambda p: placed.select(F.col("osmid").alias(p), F.col("cluster").alias(f"c{p}"))
    linking = graph.edges if max_length is None else graph.edges.where(F.col("length") <= max_length)
    inner = linking.select("u", "v").join(side("u"), "u").join(side("v"), "v").where("cu = cv").select("u", "v")
    parts = weak_components(placed, inner).withColumnRenamed("component", "part")
    placed = materialize(placed.join(parts, "osmid"), "clusters")
    centres = group_centres(placed, pairs, flat)
    rest = [c for c in nodes.columns if c not in ("osmid", "x", "y", "r", "street_count")]
    counted = "street_count" in nodes.columns
    aggs = {"elevation": F.avg} | (aggs or {})
    columns = [(aggs[c](F.col(c)) if c in aggs else F.array_sort(F.collect_set(c))).alias(c) for c in rest]
    if counted:
        columns.append(aggs["street_count"](F.col("street_count")).alias("street_count") if "street_count" in aggs
                       else F.when(F.count(F.lit(1)) == 1, F.first("street_count")).alias("street_count"))
    merged = nodes.select("osmid", *rest, *(["street_count"] if counted else [])).join(placed.select("osmid", "part"), "osmid").groupBy("part").agg(
        F.array_sort(F.collect_list("osmid")).alias("osmid_original"), *columns)
    new_nodes = merged.join(centres, "part").select(F.col("part").alias("osmid"), "x", "y", "osmid_original", *rest, *(["street_count"] if counted else []))
    if not reconnect:
        return graph.with_(nodes=new_nodes, edges=graph.edges.limit(0), attrs={**graph.attrs, "consolidated": True})
    new_nodes = materialize(new_nodes, "nodes")
    lines = edge_points(graph)
    label = lambda p: placed.select(F.col("osmid").alias(p), F.col("part").alias(f"p{p}"))
    moved = lines.join(label("u"), "u").join(label("v"), "v").where("pu <> pv OR u = v")
    place = lambda p: new_nodes.select(F.col("osmid").alias(f"p{p}"), F.struct("x", "y").alias(f"at{p}"), (F.size("osmid_original") > 1).alias(f"many{p}"))
    moved = moved.join(place("u"), "pu").join(place("v"), "pv")
    nothing = F.array().cast("array<struct<x:double,y:double>>")
    shape = F.concat(F.when(F.col("manyu"), F.array("atu")).otherwise(nothing), "geometry", F.when(F.col("manyv") & (F.col("pu") != F.col("pv")), F.array("atv")).otherwise(nothing))
    moved = moved.withColumn("geometry", shape).withColumn("length", F.when(F.col("manyu") | F.col("manyv"), line_length(F.col("geometry"), "euclid" if flat else "haversine")).otherwise(F.col("length")))
    number = F.row_number().over(Window.partitionBy("pu", "pv").orderBy("u", "v", "key")) - 1
    keep = [c for c in lines.columns if c not in ("u", "v", "key", "length", "geometry")]
    edges = materialize(moved.withColumn("_k", number.cast("int")).select(F.col("pu").alias("u"), F.col("pv").alias("v"), F.col("_k").alias("key"), "length", "geometry",
                                                                          F.col("u").alias("u_original"), F.col("v").alias("v_original"), *keep), "edges")
    streets = count_streets_per_node(new_nodes, edges).withColumnRenamed("street_count", "_new")
    known = F.coalesce("street_count", "_new") if counted else F.col("_new")
    new_nodes = new_nodes.join(streets, "osmid").withColumn("street_count", known.cast("bigint")).drop("_new")
    return graph.with_(nodes=new_nodes, edges=edges, attrs={**graph.attrs, "consolidated": True})
