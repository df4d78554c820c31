"""Points near other points and points in regions (problem 6).

Near pairs: points are put on a Morton grid in three dimensions, whose cells are
four search radii wide; the disc of a point is covered by the few cells that it
touches; points and covers meet in an equi-join on cell codes, and the distance on
the sphere decides. Poles and longitude 180 need no special case.

Regions: each part of a region is covered by quadtree cells, that is by ranges of
the sorted Morton code. A cell wholly inside needs no test. A border cell carries
a reference point with its known side and the few edges that touch the cell, so
the exact test walks from the reference to the point inside the cell and counts
crossings; no task ever holds a whole large polygon. Points and ranges meet in an
equi-join per level, which stays a shuffle join when the cover is large.

Defined cases: null or NaN coordinates are left out; repeated rows of one id count
once per distinct place; points at one place are near each other; rings with fewer
than three points enclose nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframe.functions.cells import (LEVELS, interleave, lonlat_spread, morton2_int, odd_crossings, segments_meet_box,
                                       sphere_xyz, spread3)
from roadframe.model import EARTH_RADIUS_M
from roadframe.session import materialize
from roadframe.sources.tables import current_elements

#: Cells per part of a region; more cells mean fewer exact tests, fewer cells a smaller cover.
CELLS_PER_PART = 96


def near_pairs(points: DataFrame, radius: float = 12.0, id_column: str = "osmid", lon: str = "x", lat: str = "y") -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b: all pairs of different ids at most ``radius`` metres apart on the sphere."""
    size, reach = 4.0 * radius, radius * (1 + 1e-9) + 1e-6
    usable = points.select(F.col(id_column).alias("id"), F.col(lon).alias("lon"), F.col(lat).alias("lat")).where(
        "id IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")
    x, y, z = sphere_xyz(F.col("lon"), F.col("lat"))
    placed = usable.select("id", "lon", "lat", x.alias("x"), y.alias("y"), z.alias("z"))
    cell = lambda c: F.floor((c + EARTH_RADIUS_M + size) / size)
    at = F.element_at
    index = (placed.withColumn("s", spread3(*[cell(F.col(c)) for c in "xyz"]))
             .select("id", "x", "y", "z", interleave(*[at("s", k + 1) for k in range(3)]).alias("code")))
    # the cells that the ball around a point touches: one or two per axis, tested against the ball
    both = placed.withColumn("i", F.array(*[cell(F.col(c) + d) for c in "xyz" for d in (-reach, reach)]))
    both = both.withColumn("s", spread3(*[at("i", k + 1) for k in range(6)]))
    gap = lambda c, i: F.greatest((i - 1) * size - EARTH_RADIUS_M - F.col(c), F.col(c) - i * size + EARTH_RADIUS_M, F.lit(0.0))
    both = both.withColumn("g", F.array(*[gap(c, at("i", 2 * k + e + 1)) for k, c in enumerate("xyz") for e in (0, 1)]))
    both = both.withColumn("g", F.transform("g", lambda v: v * v))
    cover = []
    for picks in product((0, 1), repeat=3):
        slots = [2 * k + e + 1 for k, e in enumerate(picks)]
        touches = sum(at("g", k) for k in slots) <= reach * reach
        cover.append(F.when(touches, interleave(*[at("s", k) for k in slots])))
    probe = both.select(F.col("id").alias("id_b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"),
                        F.explode(F.array_compact(F.array_distinct(F.array(*cover)))).alias("code"))
    chord = F.sqrt(sum((F.col(c) - F.col(f"b{c}")) * (F.col(c) - F.col(f"b{c}")) for c in "xyz"))
    arc = 2 * EARTH_RADIUS_M * F.asin(F.least(chord / (2 * EARTH_RADIUS_M), F.lit(1.0)))
    return (index.join(probe, "code").where((F.col("id") < F.col("id_b")) & (chord <= reach) & (arc <= radius))
            .select(F.col("id").alias("id_a"), "id_b").distinct())


def _part_edges(rings: list) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of a part's rings; repeated points and points without coordinates are skipped."""
    out = []
    for ring in rings or []:
        pts = [(p["x"], p["y"]) for p in ring or [] if p and p["x"] is not None and p["y"] is not None]
        if len(pts) >= 3:
            if pts[0] != pts[-1]:
                pts.append(pts[0])
            a = np.array(pts, float)
            out.append(np.hstack((a[:-1], a[1:])))
    return np.vstack(out) if out else np.zeros((0, 4))


def cover_part(edges: np.ndarray, max_cells: int = CELLS_PER_PART) -> Iterator[tuple[int, int, bool, float, float, bool, list]]:
    """Quadtree cover of one part: ``(level, prefix, inner, ref_x, ref_y, ref_inside, edges)`` per cell.

    Border cells are split, those with most edges first, until ``max_cells`` are reached.
    """
    if not len(edges):
        return
    xs, ys = edges[:, [0, 2]], edges[:, [1, 3]]
    low, high = (xs.min(), ys.min()), (xs.max(), ys.max())
    n = 1 << LEVELS

    def box(level: int, i: int, j: int) -> tuple[float, float, float, float]:
        w, h = 360.0 / (1 << level), 180.0 / (1 << level)
        return -180 + i * w, -90 + j * h, -180 + (i + 1) * w, -90 + (j + 1) * h

    level = 0
    at = lambda v, lo, span: min(max(int((v - lo) / span * n), 0), n - 1)
    first = (at(low[0], -180, 360), at(low[1], -90, 180))
    last = (at(high[0], -180, 360), at(high[1], -90, 180))
    while level < LEVELS and all(a >> (LEVELS - level - 1) == b >> (LEVELS - level - 1) for a, b in zip(first, last)):
        level += 1
    root = (level, first[0] >> (LEVELS - level), first[1] >> (LEVELS - level))
    heap = [(-len(edges), *root, np.arange(len(edges)))]
    done = 0
    while heap:
        weight, level, i, j, held = heapq.heappop(heap)
        if level < LEVELS and done + len(heap) + 4 <= max_cells:
            for a, b in product((0, 1), repeat=2):
                ci, cj = 2 * i + a, 2 * j + b
                x0, y0, x1, y1 = box(level + 1, ci, cj)
                m = 1e-9
                sub = held[segments_meet_box(*edges[held].T, (x0 - m, y0 - m, x1 + m, y1 + m))]
                if len(sub):
                    # halving the area halves what is left to test: larger cells go first
                    heapq.heappush(heap, (-len(sub) / 4.0 ** (level + 1), level + 1, ci, cj, sub))
                elif odd_crossings((x0 + x1) / 2, (y0 + y1) / 2, *edges.T):
                    done += 1
                    yield level + 1, morton2_int(ci, cj), True, 0.0, 0.0, True, []
            continue
        x0, y0, x1, y1 = box(level, i, j)
        rx, ry = x0 + (x1 - x0) * 0.4142135, y0 + (y1 - y0) * 0.5772156
        done += 1
        yield (level, morton2_int(i, j), False, rx, ry, odd_crossings(rx, ry, *edges.T),
               [dict(zip(("x1", "y1", "x2", "y2"), map(float, e))) for e in edges[held]])


COVER = ("area_id int, part int, level int, prefix bigint, inner boolean, ref_x double, ref_y double, ref_inside boolean, "
         "edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def cover_areas(areas: DataFrame, max_cells: int = CELLS_PER_PART) -> DataFrame:
    """Cover of all parts of all regions; each part is covered by its own row's task."""
    parts = areas.where("area_id IS NOT NULL").select("area_id", F.posexplode("polygons").alias("part", "rings"))
    # a fixed number of partitions is not coalesced: covering is heavy for its few bytes
    parts = parts.repartition(2 * areas.sparkSession.sparkContext.defaultParallelism)
    edge = pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.bool_(), edge]
    names = [c.split()[0] for c in COVER.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells = [(row["area_id"], row["part"], *c) for c in cover_part(_part_edges(row["rings"]), max_cells)]
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), kinds)], names=names)

    return parts.mapInArrow(run, COVER)


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """Crossings of an edge with the way from the reference point to (x, y): first along y = ``y``, then along x = ``ref_x``."""
    rx, ry = F.col("ref_x"), F.col("ref_y")
    across = ((e["y1"] <= y) != (e["y2"] <= y))
    at_x = e["x1"] + F.try_divide(y - e["y1"], e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
    along = ((e["x1"] <= rx) != (e["x2"] <= rx))
    at_y = e["y1"] + F.try_divide(rx - e["x1"], e["x2"] - e["x1"]) * (e["y2"] - e["y1"])
    hit = lambda test, v, p, q: F.when(test & ((v <= p) != (v <= q)), 1).otherwise(0)
    return hit(across, at_x, x, rx) + hit(along, at_y, y, ry)


def points_in_areas(points: DataFrame, areas: DataFrame, id_column: str = "id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``(area_id, id)``: each point with every region that has a part containing it."""
    cover = materialize(cover_areas(areas), "cover")
    levels = sorted(r[0] for r in cover.select("level").distinct().collect())  # at most LEVELS + 1 rows
    usable = points.select(F.col(id_column).alias("id"), F.col(lon).alias("lon"), F.col(lat).alias("lat")).where(
        "id IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")
    blocks = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(F.col("code"), 2 * (LEVELS - level)).alias("prefix"))
                       for level in levels or [0]])
    probe = usable.withColumn("s", lonlat_spread(F.col("lon"), F.col("lat"))).withColumn(
        "code", interleave(F.element_at("s", 1), F.element_at("s", 2))).select("id", "lon", "lat", F.explode(blocks).alias("_b")).select(
        "id", "lon", "lat", "_b.level", "_b.prefix")
    odd = F.aggregate("edges", F.lit(0), lambda n, e: n + _crosses(e, F.col("lon"), F.col("lat"))) % 2 == 1
    return (probe.join(cover, ["level", "prefix"]).where(F.col("inner") | (F.col("ref_inside") != odd))
            .select("area_id", "id").distinct())


def amenity_nodes(elements: DataFrame) -> DataFrame:
    """``(id, lon, lat)`` of current, undeleted node elements with an ``amenity`` tag and both coordinates."""
    nodes = elements.where(F.col("type") == "node").withColumn("amenity", F.col("tags")["amenity"])
    return (current_elements(nodes, "lat", "lon", "amenity")
            .where("visible AND amenity IS NOT NULL").select("id", "lon", "lat"))


def proximity_found(nodes: DataFrame, elements: DataFrame, areas: DataFrame) -> DataFrame:
    """Near pairs of graph nodes and regions that contain amenity nodes, in one table ``(kind, id_a, id_b)``."""
    near = near_pairs(nodes).select(F.lit("near").alias("kind"), "id_a", "id_b")
    inside = points_in_areas(amenity_nodes(elements), areas).select(
        F.lit("inside").alias("kind"), F.col("area_id").cast("bigint").alias("id_a"), F.col("id").alias("id_b"))
    return near.unionByName(inside)
