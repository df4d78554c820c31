"""Geographic scalar functions as Spark column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadframe.model import EARTH_RADIUS_M

ColumnLike = Column | float | int


def _c(value: ColumnLike) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def great_circle(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike, radius: float = EARTH_RADIUS_M) -> Column:
    """Haversine distance in the unit of ``radius``; null coordinates give null."""
    a, b, c, d = map(_c, (lat1, lon1, lat2, lon2))
    half = lambda p, q: F.sin(F.radians(q - p) / 2)
    h = half(a, c) * half(a, c) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * half(b, d) * half(b, d)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def euclidean(y1: ColumnLike, x1: ColumnLike, y2: ColumnLike, x2: ColumnLike) -> Column:
    dy, dx = _c(y2) - _c(y1), _c(x2) - _c(x1)
    return F.sqrt(dy * dy + dx * dx)


def bearing(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    """Initial compass bearing in [0, 360)."""
    a, c = F.radians(_c(lat1)), F.radians(_c(lat2))
    turn = F.radians(_c(lon2) - _c(lon1))
    east = F.sin(turn) * F.cos(c)
    north = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def bbox_from_point(lat: ColumnLike, lon: ColumnLike, dist: float, radius: float = EARTH_RADIUS_M) -> Column:
    """Struct (left, bottom, right, top) reaching ``dist`` metres from a point."""
    dlat = math.degrees(dist / radius)
    dlon = F.lit(dlat) / F.cos(F.radians(_c(lat)))
    return F.struct((_c(lon) - dlon).alias("left"), (_c(lat) - dlat).alias("bottom"),
                    (_c(lon) + dlon).alias("right"), (_c(lat) + dlat).alias("top"))


# WGS84 and the series of the transverse Mercator projection (fixed values)
_A, _F, _K0 = 6_378_137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4,
          61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)


def utm_epsg(lon: float, lat: float) -> int:
    """EPSG code of the zone that holds a point; polar stereographic beyond 84 north and 80 south."""
    if lat > 84:
        return 32661
    if lat < -80:
        return 32761
    zone = min(int((lon + 180) // 6) + 1, 60)
    return (32600 if lat >= 0 else 32700) + zone


def project(lon: ColumnLike, lat: ColumnLike, epsg: int) -> Column:
    """Struct (x, y) in metres in a UTM zone (326zz, 327zz) or polar stereographic (32661, 32761)."""
    if epsg in (32661, 32761):
        return _polar(_c(lon), _c(lat), epsg == 32661)
    south, zone = divmod(epsg - 32600, 100)
    return project_utm(lon, lat, F.lit(zone), F.lit(bool(south)))


def utm_zone(lon: ColumnLike) -> Column:
    """Number of the UTM zone of a longitude; 180 belongs to the last one."""
    return F.least(F.floor((_c(lon) + 180) / 6) + 1, F.lit(60)).cast("int")


def project_utm(lon: ColumnLike, lat: ColumnLike, zone: Column, south: Column) -> Column:
    """Struct (x, y) in metres in a UTM zone that may differ from row to row."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500_000.0 + _K0 * _RECT * x).alias("x"), (F.when(south, 10_000_000.0).otherwise(0.0) + _K0 * _RECT * y).alias("y"))


def _polar(lon: Column, lat: Column, north: bool) -> Column:
    sign = 1 if north else -1
    e = math.sqrt(_F * (2 - _F))
    phi, lam = F.radians(lat * sign), F.radians(lon)
    es = e * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))
    rho = t * (2 * _A * 0.994 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e)))
    return F.struct((2_000_000.0 + rho * F.sin(lam)).alias("x"), (2_000_000.0 - sign * rho * F.cos(lam)).alias("y"))


Ring = list[tuple[float, float]]


def banded_sides(y: Column, parts: list[list[Ring]], margin: float = 0.0) -> Column:
    """The sides (x1, y1, x2, y2, part) of closed rings that pass within ``margin`` of a latitude.

    All sides are one constant, listed by bands of latitude, so an expression over
    them does not grow with the corners and a point meets only its own band's sides.
    """
    sides = [(*map(float, p), *map(float, q), i) for i, part in enumerate(parts) for r in part for p, q in zip(r[:-1], r[1:])]
    low = min(min(s[1], s[3]) for s in sides) - margin
    high = max(max(s[1], s[3]) for s in sides) + margin
    n = max(1, min(1024, len(sides) // 4))
    height = max((high - low) / n, 1e-12)
    bands: list[list[dict]] = [[] for _ in range(n)]
    for side in sides:
        first, last = (int((v - low) / height) for v in (min(side[1], side[3]) - margin, max(side[1], side[3]) + margin))
        for i in range(max(first - 1, 0), min(last + 1, n - 1) + 1):
            bands[i].append(dict(zip(("x1", "y1", "x2", "y2", "part"), side)))
    table = F.from_json(F.lit(json.dumps(bands)), "array<array<struct<x1:double,y1:double,x2:double,y2:double,part:int>>>")
    at = F.least(F.greatest(F.floor((y - low) / height), F.lit(0)), F.lit(n - 1)).cast("int")
    return F.when(y.between(low, high), F.get(table, at))


def inside_parts(x: Column, y: Column, parts: list[list[Ring]]) -> Column:
    """Inside the shell and in no hole of any of several polygons; borders, also of holes, belong to them.

    The box around all shells is tested first, so a scan can use it.
    """
    def on_side(s: Column) -> Column:
        cross = (x - s["x1"]) * (s["y2"] - s["y1"]) - (y - s["y1"]) * (s["x2"] - s["x1"])
        return (cross == 0) & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))

    def crossed(s: Column) -> Column:
        at = s["x1"] + F.try_divide(y - s["y1"], s["y2"] - s["y1"]) * (s["x2"] - s["x1"])
        return ((s["y1"] <= y) != (s["y2"] <= y)) & (at > x)

    corners = [p for part in parts for p in part[0]]
    box = x.between(min(p[0] for p in corners), max(p[0] for p in corners)) & y.between(min(p[1] for p in corners), max(p[1] for p in corners))
    sides = banded_sides(y, parts)
    hits = F.transform(F.filter(sides, crossed), lambda s: s["part"])  # the part of each side right of the point
    odd = F.size(hits) % 2 == 1 if len(parts) == 1 else F.exists(F.array_distinct(hits), lambda p: F.size(F.filter(hits, lambda h: h == p)) % 2 == 1)
    return box & F.coalesce(F.exists(sides, on_side) | odd, F.lit(False))


def inside_polygon(x: Column, y: Column, polygon: list[Ring]) -> Column:
    return inside_parts(x, y, as_parts(polygon))


def as_parts(polygon: list) -> list[list[list[tuple[float, float]]]]:
    """A polygon (rings) or several (lists of rings) as several, every ring closed."""
    several = polygon if isinstance(polygon[0][0][0], (list, tuple)) else [polygon]
    close = lambda r: [tuple(p) for p in r] if tuple(r[0]) == tuple(r[-1]) else [*[tuple(p) for p in r], tuple(r[0])]
    return [[close(r) for r in part] for part in several]


def require_simple(parts: list[list[list[tuple[float, float]]]]) -> None:
    """Every ring has three corners at least and does not cross itself; raises ``ValueError`` otherwise."""
    for ring in (r for part in parts for r in part):
        p = np.array(ring, float)
        if len(p) < 4 or not np.isfinite(p).all():
            raise ValueError("a ring needs three corners at least, all finite")
        a, b = p[:-1], p[1:]
        turn = lambda o, d, q: d[0] * (q[:, 1] - o[1]) - d[1] * (q[:, 0] - o[0])
        for i in range(len(a)):
            d = b[i] - a[i]
            one, two = turn(a[i], d, a), turn(a[i], d, b)
            e = b - a
            back = lambda q: e[:, 0] * (q[1] - a[:, 1]) - e[:, 1] * (q[0] - a[:, 0])
            if ((one * two < 0) & (back(a[i]) * back(b[i]) < 0)).any():
                raise ValueError("a ring crosses itself")


def within_distance(x: Column, y: Column, parts: list[list[list[tuple[float, float]]]], dist: float) -> Column:
    """Inside, or at most ``dist`` metres from a side, of polygons in degrees.

    Distances are taken on the plane around each point where a degree of longitude has the length it has there.
    """
    metre = math.degrees(1 / EARTH_RADIUS_M)
    shrink = F.cos(F.radians(y))

    def close(s: Column) -> Column:
        dx, dy = (s["x2"] - s["x1"]) * shrink, s["y2"] - s["y1"]
        px, py = (x - s["x1"]) * shrink, y - s["y1"]
        t = F.greatest(F.least(F.coalesce(F.try_divide(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        gx, gy = px - t * dx, py - t * dy
        return gx * gx + gy * gy <= (dist * metre) ** 2

    near = F.coalesce(F.exists(banded_sides(y, parts, dist * metre), close), F.lit(False))
    return inside_parts(x, y, parts) | near


def line_length(points: Column, metric: str = "haversine") -> Column:
    """Length of an array of (x, y) points."""
    legs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
                      lambda p, q: great_circle(p["y"], p["x"], q["y"], q["x"]) if metric == "haversine" else euclidean(p["y"], p["x"], q["y"], q["x"]))
    return F.aggregate(legs, F.lit(0.0), lambda a, b: a + b)


def wkt_line(points: Column) -> Column:
    text = F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("LINESTRING ("), F.array_join(text, ", "), F.lit(")"))


def parse_wkt_line(text: Column) -> Column:
    """Array of (x, y) points of a LINESTRING; null for null or other text."""
    body = F.regexp_extract(text, r"(?i)^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    pts = F.transform(F.split(body, ","), lambda s: F.struct(
        F.split(F.trim(s), r"\s+")[0].try_cast("double").alias("x"), F.get(F.split(F.trim(s), r"\s+"), F.lit(1)).try_cast("double").alias("y")))
    return F.when(body != "", pts)


def interpolate_lines(lines: DataFrame, dist: float, keep: list[str], geometry: str = "geometry") -> DataFrame:
    """``keep`` columns plus ``points``: evenly spaced points along each line, about ``dist`` apart (planar), both ends included.

    The number of steps is the length over ``dist``, rounded half to even, at least
    one; null for lines with fewer than two points. A numpy kernel: running lengths
    and places along them are two folds and a search per point as array expressions.
    """
    schema = T.StructType([*(lines.schema[c] for c in keep), T.StructField("points", T.ArrayType(T.StructType(
        [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))])
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def one(line: list | None) -> list | None:
        if not line or len(line) < 2:
            return None
        xy = np.array([(p["x"], p["y"]) for p in line], float)
        sums = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))))
        at = np.linspace(0.0, sums[-1], max(round(sums[-1] / dist), 1) + 1)
        return [{"x": a, "y": b} for a, b in zip(np.interp(at, sums, xy[:, 0]).tolist(), np.interp(at, sums, xy[:, 1]).tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [one(v.as_py()) for v in batch.column(geometry)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(points, kind)], names=[*keep, "points"])

    return lines.select(*dict.fromkeys([*keep, geometry])).mapInArrow(run, schema)
