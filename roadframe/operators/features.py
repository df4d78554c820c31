"""Map features: elements with tags and their geometry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframe.functions.geo import as_parts, inside_parts, inside_polygon
from roadframe.operators.filters import tag_predicate
from roadframe.sources.tables import current_elements

RELATION_TYPES = ("boundary", "multipolygon")
# Keys that make a closed way an area; for the last two groups only with, or not with, some values.
AREA_KEYS = ("amenity", "area", "area:highway", "boundary", "building", "building:part", "craft", "golf", "historic", "indoor", "landuse",
             "leisure", "military", "office", "place", "public_transport", "ruins", "shop", "tourism")
AREA_WITH = {
    "barrier": ("city_wall", "ditch", "hedge", "retaining_wall", "spikes"),
    "highway": ("elevator", "escape", "rest_area", "services"),
    "power": ("generator", "plant", "substation", "transformer"),
    "railway": ("platform", "roundhouse", "station", "turntable"),
    "waterway": ("boatyard", "dam", "dock", "riverbank"),
}
AREA_WITHOUT = {
    "aeroway": ("taxiway",),
    "man_made": ("cutline", "embankment", "pipeline"),
    "natural": ("arete", "cliff", "coastline", "ridge", "tree_row"),
}
POINTS = "array<struct<x:double,y:double>>"


def is_area(tags: Column) -> Column:
    """Whether the tags of a closed way make it an area; ``area=no`` always says no."""
    tests = [tags[k].isNotNull() for k in AREA_KEYS]
    tests += [F.coalesce(tags[k].isin(*v), F.lit(False)) for k, v in AREA_WITH.items()]
    tests += [F.coalesce(~tags[k].isin(*v), F.lit(False)) for k, v in AREA_WITHOUT.items()]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(tags["area"] != "no", F.lit(True)) & out


def way_geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, tags, closed, kind, points)``: ``kind`` is LineString or Polygon; a way with a missing node has null points."""
    refs = ways.select(F.col("osmid").alias("id"), F.posexplode("nodes").alias("pos", "ref"))
    placed = refs.join(nodes.select(F.col("osmid").alias("ref"), "x", "y"), "ref", "left")
    lines = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"), F.count_if(F.col("x").isNull()).alias("lost"))
    out = ways.select(F.col("osmid").alias("id"), "nodes", "tags").join(lines, "id")
    closed = (F.size("nodes") >= 4) & (F.element_at("nodes", 1) == F.element_at("nodes", -1))
    points = F.when((F.col("lost") == 0) & (F.size("nodes") >= 2), F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))))
    return out.select("id", "tags", closed.alias("closed"), F.when(closed & is_area(F.col("tags")), "Polygon").otherwise("LineString").alias("kind"), points.alias("points"))


def stitch_rings(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from lines that meet at their ends; a line that closes with nothing is left out."""
    rings, open_ = [], []
    for line in lines:
        (rings if line and line[0] == line[-1] and len(line) > 3 else open_).append(list(line))
    open_ = [x for x in open_ if len(x) > 1]
    while open_:
        chain = open_.pop(0)
        joined = True
        while joined and chain[0] != chain[-1]:
            joined = False
            for i, other in enumerate(open_):
                if other[0] == chain[-1] or other[-1] == chain[-1]:
                    chain += (other if other[0] == chain[-1] else other[::-1])[1:]
                elif other[-1] == chain[0] or other[0] == chain[0]:
                    chain = (other if other[-1] == chain[0] else other[::-1])[:-1] + chain
                else:
                    continue
                open_.pop(i)
                joined = True
                break
        if chain[0] == chain[-1] and len(chain) > 3:
            rings.append(chain)
    return rings


def _holds(ring: list[tuple[float, float]], points: list[tuple[float, float]]) -> bool:
    """Whether every point lies in or on the ring."""
    for x, y in points:
        odd = edge = False
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
            if (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                edge = True
                break
            if (y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x:
                odd = not odd
        if not odd and not edge:
            return False
    return True


def assemble_multipolygon(outer: list, inner: list) -> list[list[list[tuple[float, float]]]]:
    """Parts (shell first, then its holes). An outer ring inside a hole is an island, a part of its own."""
    shells, holes = stitch_rings(outer), stitch_rings(inner)
    parts = [[s] for s in shells]
    for hole in holes:
        around = [i for i, s in enumerate(shells) if _holds(s, hole)]
        if around:  # the innermost shell around it
            best = max(around, key=lambda i: sum(_holds(shells[j], shells[i]) for j in around))
            parts[best].append(hole)
    return parts


def multipolygon_wkt(parts: list) -> str | None:
    if not parts:
        return None
    ring = lambda r: "(" + ", ".join(f"{x:.15g} {y:.15g}" for x, y in r) + ")"
    bodies = ["(" + ", ".join(ring(r) for r in part) + ")" for part in parts]
    return f"POLYGON {bodies[0]}" if len(bodies) == 1 else "MULTIPOLYGON (" + ", ".join(bodies) + ")"


def _sides(paths: list[list[tuple[float, float]]]) -> np.ndarray:
    """Sides (x1, y1, x2, y2) of lines and rings; a lone point is a side of no length."""
    parts = [np.hstack((a[:-1], a[1:]) if len(a) > 1 else (a, a)) for a in (np.array(p, float) for p in paths)]
    return np.vstack(parts)


def _meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any side of ``a`` meets any side of ``b``; touching counts."""
    boxed = lambda s: (np.minimum(s[:, 0], s[:, 2]), np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 0], s[:, 2]), np.maximum(s[:, 1], s[:, 3]))
    turn = lambda s, x, y: (s[:, 2] - s[:, 0]) * (y - s[:, 1]) - (s[:, 3] - s[:, 1]) * (x - s[:, 0])
    low_x, low_y, high_x, high_y = boxed(b)
    for side, x0, y0, x1, y1 in zip(a, *boxed(a)):
        s = b[(low_x <= x1) & (high_x >= x0) & (low_y <= y1) & (high_y >= y0)]
        one = side[None].repeat(len(s), 0)
        if len(s) and (((np.sign(turn(s, side[0], side[1])) * np.sign(turn(s, side[2], side[3]))) <= 0)
                       & ((np.sign(turn(one, s[:, 0], s[:, 1])) * np.sign(turn(one, s[:, 2], s[:, 3]))) <= 0)).any():
            return True
    return False


def _odd(x: float, y: float, sides: np.ndarray) -> bool:
    x1, y1, x2, y2 = sides[(sides[:, 1] <= y) != (sides[:, 3] <= y)].T
    return bool((x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x).sum() % 2)


def meets_polygon(paths: list[list[tuple[float, float]]], area: bool, polygon: list[list[tuple[float, float]]]) -> bool:
    """Whether lines, or the rings of an area, share a point with a polygon (shell first, then holes; borders belong to both)."""
    mine, other = _sides(paths), _sides([r if r[0] == r[-1] else [*r, r[0]] for r in polygon])
    if _meet(mine, other):
        return True
    # no sides meet: each path lies wholly on one side of the polygon's border, and the shell wholly on one side of the area's
    return any(_odd(*p[0], other) for p in paths) or (area and _odd(*polygon[0][0], mine))


def relation_geometry(relations: DataFrame, ways: DataFrame, polygons: list[list[list[tuple[float, float]]]] | None = None) -> DataFrame:
    """``(id, wkt, parts, holes)`` of boundary and multipolygon relations; a missing member way leaves the geometry null.

    With ``polygons`` also ``meets``: whether the geometry shares a point with one of them.
    ``relations`` has ``(id, members, tags)``, ``ways`` has ``(id, points)``. A role that is null or empty counts as outer.
    """
    wanted = relations.where(F.col("tags")["type"].isin(*RELATION_TYPES))
    members = wanted.select("id", F.posexplode("members").alias("pos", "m")).where("m.type = 'way'").select("id", "pos", F.col("m.ref").alias("ref"), F.col("m.role").alias("role"))
    rows = members.join(ways.select(F.col("id").alias("ref"), "points"), "ref", "left").select("id", "pos", "role", "points")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        wkt, parts = None, []
        if not pdf["points"].isna().any():
            line = lambda p: [(q["x"], q["y"]) for q in p]
            inner = [line(p) for p, r in zip(pdf["points"], pdf["role"]) if r == "inner"]
            parts = assemble_multipolygon([line(p) for p, r in zip(pdf["points"], pdf["role"]) if r != "inner"], inner)
            wkt = multipolygon_wkt(parts)
        out = pd.DataFrame({"id": [pdf["id"].iloc[0]], "wkt": [wkt], "parts": [len(parts)], "holes": [sum(len(p) - 1 for p in parts)]})
        return out if polygons is None else out.assign(meets=bool(parts) and any(meets_polygon([r for p in parts for r in p], True, one) for one in polygons))

    return rows.groupBy("id").applyInPandas(build, "id bigint, wkt string, parts int, holes int" + (", meets boolean" if polygons is not None else ""))


def current_features(elements: DataFrame, query: dict[str, bool | str | list[str]]) -> DataFrame:
    """``(element, id, tags)`` of current elements whose tags fit any part of the query."""
    rows = current_elements(elements, "tags").where("visible")
    return rows.where(tag_predicate(query)).select(F.col("type").alias("element"), "id", "tags")


def features_in_polygon(points: DataFrame, polygon: list[list[tuple[float, float]]], query: dict[str, bool | str | list[str]]) -> DataFrame:
    """Point features ``(id, x, y, tags)`` in or on a polygon that fit the query."""
    return points.where(inside_polygon(F.col("x"), F.col("y"), polygon) & tag_predicate(query))


def features_meeting_polygon(points: DataFrame, ways: DataFrame, relations: DataFrame, polygons: list | None, query: dict[str, bool | str | list[str]]) -> DataFrame:
    """``(element, id, tags)`` of nodes, ways and relations that fit the query and whose geometry shares a point with a polygon or one of several.

    ``points`` has ``(id, x, y, tags)``, ``ways`` is ``way_geometry``'s result with all member ways, ``relations`` has ``(id, members, tags)``.
    Features without geometry are left out. No polygon: every place fits; an empty query: every tagged element fits.
    """
    fits = tag_predicate(query) if query else F.coalesce(F.size("tags") > 0, F.lit(False))
    tagged, wanted = ways.where(F.col("points").isNotNull() & fits), relations.where(fits)
    if polygons is None:
        nodes, lines = points.where(fits), tagged
        areas = wanted.join(relation_geometry(wanted, ways).where("wkt IS NOT NULL"), "id", "left_semi")
    else:
        parts = as_parts(polygons)
        nodes = points.where(inside_parts(F.col("x"), F.col("y"), parts) & fits)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                met = [any(meets_polygon([[(q["x"], q["y"]) for q in p]], kind == "Polygon", one) for one in parts) for p, kind in zip(batch["points"], batch["kind"])]
                yield batch.loc[met, ["id"]]

        corners = [p for part in parts for p in part[0]]
        xs, ys = [p[0] for p in corners], [p[1] for p in corners]
        axis = lambda c: F.transform("points", lambda p: p[c])
        boxed = (F.array_min(axis("x")) <= max(xs)) & (F.array_max(axis("x")) >= min(xs)) & (F.array_min(axis("y")) <= max(ys)) & (F.array_max(axis("y")) >= min(ys))
        lines = tagged.join(tagged.where(boxed).select("id", "kind", "points").mapInPandas(run, "id bigint"), "id", "left_semi")
        areas = wanted.join(relation_geometry(wanted, ways, parts).where("meets"), "id", "left_semi")
    named = lambda rows, kind: rows.select(F.lit(kind).alias("element"), "id", "tags")
    return named(nodes, "node").unionByName(named(lines, "way")).unionByName(named(areas, "relation"))


def used_tag_keys(features: DataFrame) -> DataFrame:
    """``(tag, n)``: the columns that a wide table of these features would have, by how many features fill them."""
    return features.select(F.explode(F.map_keys("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
