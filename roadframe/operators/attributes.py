"""Edge and node attributes: bearings, grades, speeds, travel times, elevations, colours."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadframe.functions.geo import bearing, project, project_utm, utm_zone
from roadframe.functions.maxspeed import clean_maxspeed
from roadframe.model import StreetGraph, ValidationError
from roadframe.operators.build import with_endpoints
from roadframe.session import broadcast_if_small, materialize


def add_bearings(graph: StreetGraph) -> DataFrame:
    """Edges with ``bearing``; null for self-loops. Needs unprojected coordinates."""
    if graph.projected:
        raise ValueError("bearings need longitude and latitude")
    ends = with_endpoints(graph.edges, graph.nodes, "x", "y")
    angle = bearing(F.col("u_y"), F.col("u_x"), F.col("v_y"), F.col("v_x"))
    return ends.withColumn("bearing", F.when(F.col("u") != F.col("v"), angle)).drop("u_x", "u_y", "v_x", "v_y")


def add_grades(graph: StreetGraph, absolute: bool = True) -> DataFrame:
    """Edges with ``grade`` (rise over run) and its absolute value; null where an elevation is unknown or the length is zero."""
    ends = with_endpoints(graph.edges, graph.nodes, "elevation")
    out = ends.withColumn("grade", F.try_divide(F.col("v_elevation") - F.col("u_elevation"), F.col("length"))).drop("u_elevation", "v_elevation")
    return out.withColumn("grade_abs", F.abs("grade")) if absolute else out


def add_speeds(edges: DataFrame, hwy_speeds: dict[str, float] | None = None, fallback: float | None = None,
               agg: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Edges with ``speed_kph``: the stated limit, else the type's given or aggregated speed, else ``fallback`` or the mean of the types' speeds."""
    rows = edges.withColumn("_stated", clean_maxspeed(F.col("maxspeed")))
    per_type = rows.where("highway IS NOT NULL").groupBy("highway").agg(agg(F.col("_stated")).alias("_typical"))
    if hwy_speeds:
        given = F.create_map(*[F.lit(x) for k, v in hwy_speeds.items() for x in (k, float(v))])
        per_type = per_type.withColumn("_typical", F.coalesce(given[F.col("highway")], "_typical"))
        more = edges.sparkSession.createDataFrame([(k, float(v)) for k, v in hwy_speeds.items()], "highway string, _typical double")
        per_type = per_type.unionByName(more.join(per_type, "highway", "left_anti"))
    per_type = broadcast_if_small(per_type)
    rest = F.lit(float(fallback)) if fallback is not None else F.col("_rest")
    mean = per_type.agg(F.avg("_typical").alias("_rest"))  # one row
    out = rows.join(per_type, "highway", "left").join(F.broadcast(mean), F.lit(True))
    typical = F.when(F.col("highway").isNotNull(), F.coalesce("_typical", rest))
    return out.withColumn("speed_kph", F.coalesce("_stated", typical)).drop("_stated", "_typical", "_rest")


def add_travel_times(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Edges with ``travel_time`` in seconds; a null length or speed gives null, or an error when ``strict``."""
    time = F.try_divide(F.col("length") / 1000, F.col("speed_kph") / 3600)
    if strict:
        time = F.coalesce(time, F.raise_error(F.lit("length and speed_kph must not be null")).cast("double"))
    return edges.withColumn("travel_time", time)


def sample_raster(nodes: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float, dy: float, nodata: float | None = None) -> DataFrame:
    """Nodes with ``elevation`` from a gridded raster ``(col, row, value)`` whose upper left corner is (x0, y0)."""
    placed = nodes.withColumn("col", F.floor((F.col("x") - x0) / dx)).withColumn("row", F.floor((F.lit(y0) - F.col("y")) / dy))
    value = F.when(~F.isnan("value") & (F.lit(nodata).isNull() | (F.col("value") != nodata)), F.col("value")) if nodata is not None else F.when(~F.isnan("value"), F.col("value"))
    return placed.drop("elevation").join(cells.select("col", "row", value.alias("elevation")), ["col", "row"], "left").drop("col", "row")


def elevation_batches(nodes: DataFrame, size: int = 512) -> DataFrame:
    """``(batch, n, locations)``: "lat,lon" texts with six decimals, joined by "|", in groups of at most ``size``.

    Nodes are dealt to hashed groups first and numbered inside each, so no task numbers all nodes.
    """
    groups = max(64, nodes.count() // 1_000_000)
    spread = nodes.select("osmid", F.format_string("%.6f,%.6f", F.col("y"), F.col("x")).alias("place"), F.pmod(F.col("osmid"), F.lit(groups)).alias("g"))
    number = F.row_number().over(Window.partitionBy("g").orderBy("osmid")) - 1
    rows = spread.withColumn("b", F.floor(number / size))
    out = rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("osmid", "place"))).alias("p"))
    return out.select((F.col("b") * groups + F.col("g")).alias("batch"), "n", F.array_join(F.transform("p", lambda s: s["place"]), "|").alias("locations"))


def project_nodes(nodes: DataFrame, epsg: int) -> DataFrame:
    xy = project(F.col("x"), F.col("y"), epsg)
    return nodes.withColumn("_xy", xy).withColumn("x", F.col("_xy.x")).withColumn("y", F.col("_xy.y")).drop("_xy")


def project_nodes_by_zone(nodes: DataFrame) -> DataFrame:
    """Nodes in the UTM zone of their own longitude and hemisphere, named by ``epsg``; all three null beyond 84 north and 80 south."""
    fits = F.col("y").between(-80, 84)
    zone, south = utm_zone(F.col("x")), F.col("y") < 0
    rows = nodes.withColumn("_xy", F.when(fits, project_utm(F.col("x"), F.col("y"), zone, south)))
    rows = rows.withColumn("epsg", F.when(fits, F.when(south, 32700).otherwise(32600) + zone))
    return rows.withColumn("x", F.col("_xy.x")).withColumn("y", F.col("_xy.y")).drop("_xy")


def project_graph(graph: StreetGraph, epsg: int | None = None) -> StreetGraph:
    """Nodes, and edge geometry where present, in the given system or in the UTM zone of the centre of all nodes."""
    from roadframe.functions.geo import utm_epsg

    if epsg is None:
        centre = graph.nodes.agg(F.avg("x"), F.avg("y")).first()
        if centre[0] is None:
            raise ValidationError("an empty graph has no zone")
        epsg = utm_epsg(centre[0], centre[1])
    edges = graph.edges
    if "geometry" in edges.columns:
        edges = edges.withColumn("geometry", F.transform("geometry", lambda p: project(p["x"], p["y"], epsg)))
    return graph.with_(nodes=project_nodes(graph.nodes, epsg), edges=edges, attrs={**graph.attrs, "crs": epsg})


def scaled_values(rows: DataFrame, column: str, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """Add ``position``: the value mapped linearly from its range onto a stretch of a colour map; null stays null."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.when(F.col(column).isNotNull(), F.lit(0.0)))
    return rows.join(F.broadcast(ends), F.lit(True)).withColumn("position", share * (stop - start) + start).drop("_lo", "_hi")


def exact_quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation, all null without values: rows are sorted by range, and only the ranges that hold a wanted rank are numbered."""
    values = rows.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    placed = materialize(values.repartitionByRange("x").sortWithinPartitions("x").withColumn("p", F.spark_partition_id()), "sorted")
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per range
    total = sum(n for _, n in sizes)
    if not total:
        return [None for _ in shares]
    wanted = sorted({k for s in shares for k in (math.floor((total - 1) * s), math.ceil((total - 1) * s))})
    spots, before = {}, 0
    for p, n in sizes:
        spots.update({(p, k - before): k for k in wanted if before <= k < before + n})
        before += n
    number = F.row_number().over(Window.partitionBy("p").orderBy("x")) - 1
    ranked = placed.where(F.col("p").isin(sorted({p for p, _ in spots}))).withColumn("i", number)
    hits = {spots[r["p"], r["i"]]: r["x"] for r in ranked.where(F.struct("p", "i").isin([F.struct(F.lit(p), F.lit(i)) for p, i in spots])).collect()}  # two per share
    return [hits[math.floor((total - 1) * s)] + (hits[math.ceil((total - 1) * s)] - hits[math.floor((total - 1) * s)]) * ((total - 1) * s % 1) for s in shares]


def binned_values(rows: DataFrame, column: str, bins: int, equal_size: bool = False) -> DataFrame:
    """Add ``bin`` from 0: equal widths of the range, or equal shares of the rows (equal values always share a bin)."""
    if equal_size:
        cuts = exact_quantiles(rows, column, [k / bins for k in range(1, bins)])
        place = sum((F.when(F.col(column) > F.lit(q), 1).otherwise(0) for q in cuts), F.lit(0))
        return rows.withColumn("bin", F.when(F.col(column).isNotNull(), place))
    else:
        edges = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        width = (F.col("_hi") - F.col("_lo")) / bins
        place = sum((F.when(F.col(column) > F.col("_lo") + k * width, 1).otherwise(0) for k in range(1, bins)), F.lit(0))
        drop = ["_lo", "_hi"]
    return rows.join(F.broadcast(edges), F.lit(True)).withColumn("bin", F.when(F.col(column).isNotNull(), place)).drop(*drop)
