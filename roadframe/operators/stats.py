"""Descriptive statistics of a street graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframe.functions.geo import euclidean, great_circle
from roadframe.model import StreetGraph
from roadframe.operators.build import with_endpoints
from roadframe.operators.convert import to_undirected
from roadframe.session import materialize


def count_streets_per_node(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(osmid, street_count)``: incident streets; a reciprocal pair with one key is one street, any self-loops count two in all."""
    a, b = F.least("u", "v"), F.greatest("u", "v")
    streets = edges.where("u <> v").select(a.alias("a"), b.alias("b"), "key").distinct()
    ends = streets.select(F.explode(F.array("a", "b")).alias("osmid")).groupBy("osmid").count()
    loops = edges.where("u = v").select(F.col("u").alias("osmid")).distinct().withColumn("loops", F.lit(2))
    return (nodes.select("osmid").join(ends, "osmid", "left").join(loops, "osmid", "left")
            .select("osmid", (F.coalesce("count", F.lit(0)) + F.coalesce("loops", F.lit(0))).cast("bigint").alias("street_count")))


def streets_per_node_avg(counts: DataFrame) -> DataFrame:
    return counts.agg(F.try_divide(F.sum("street_count"), F.count(F.lit(1))).alias("streets_per_node_avg"))


def streets_per_node_counts(counts: DataFrame) -> DataFrame:
    """``(streets, n, proportion)`` for every number from 0 to the largest, also those that no node has."""
    have = counts.groupBy(F.col("street_count").alias("streets")).agg(F.count(F.lit(1)).alias("n"))
    ends = have.agg(F.max("streets").alias("top"), F.sum("n").alias("total"))
    every = ends.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "top")).alias("streets"), "total")
    out = every.join(have, "streets", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("streets", n.alias("n"), (n / F.col("total")).alias("proportion"))


def intersection_count(counts: DataFrame, min_streets: int = 2) -> DataFrame:
    return counts.agg(F.count_if(F.col("street_count") >= min_streets).alias("intersection_count"))


def edge_totals(edges: DataFrame, prefix: str) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias(f"{prefix}_count"), F.sum("length").alias(f"{prefix}_length_total"), F.avg("length").alias(f"{prefix}_length_avg"))


def self_loop_proportion(streets: DataFrame) -> DataFrame:
    return streets.agg(F.avg((F.col("u") == F.col("v")).cast("int")).alias("self_loop_proportion"))


def circuity_avg(graph: StreetGraph, streets: DataFrame) -> DataFrame:
    """Total length over total straight-line distance; null when that is zero."""
    ends = with_endpoints(streets, graph.nodes, "x", "y")
    metric = euclidean if graph.projected else great_circle
    line = metric(F.col("u_y"), F.col("u_x"), F.col("v_y"), F.col("v_x"))
    return ends.agg(F.try_divide(F.sum("length"), F.sum(line)).alias("circuity_avg"))


def basic_stats(graph: StreetGraph, area: float | None = None, clean_int_tol: float | None = None) -> DataFrame:
    """One row with all measures; densities are per square kilometre of ``area`` (in square metres).

    ``streets_per_node_counts`` and ``streets_per_node_proportions`` are maps by number of streets. With ``clean_int_tol``
    (metres) also the number of places that intersections within that tolerance merge to. A ``street_count`` column of
    the nodes is used where there is one.
    """
    from roadframe.operators.simplify import merged_places

    counted = "street_count" in graph.nodes.columns
    counts = graph.nodes.select("osmid", "street_count") if counted else count_streets_per_node(graph.nodes, graph.edges)
    counts = materialize(counts, "counts")
    streets = materialize(to_undirected(graph), "streets")
    per_node = counts.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum("street_count"), F.count(F.lit(1))).alias("streets_per_node_avg"),
                          F.count_if(F.col("street_count") >= 2).alias("intersection_count"))
    every = streets_per_node_counts(counts)
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("streets", c))))
    shares = every.agg(entry("n").alias("streets_per_node_counts"), entry("proportion").alias("streets_per_node_proportions"))  # one entry per number of streets
    loops = F.avg((F.col("u") == F.col("v")).cast("int")).alias("self_loop_proportion")
    per_street = streets.agg(F.count(F.lit(1)).alias("street_segment_count"), F.sum("length").alias("street_length_total"), F.avg("length").alias("street_length_avg"), loops)
    out = edge_totals(graph.edges, "edge").withColumnRenamed("edge_count", "m")
    parts = [per_node, shares, per_street, circuity_avg(graph, streets)]
    densities = [("n", "node_density_km"), ("intersection_count", "intersection_density_km"), ("edge_length_total", "edge_density_km"), ("street_length_total", "street_density_km")]
    if clean_int_tol:
        places = merged_places(graph.with_(nodes=graph.nodes.drop("street_count").join(counts, "osmid")), clean_int_tol, dead_ends=False)
        parts.append(places.agg(F.count(F.lit(1)).alias("clean_intersection_count")))
        densities.append(("clean_intersection_count", "clean_intersection_density_km"))
    for row in parts:
        out = out.join(F.broadcast(row), F.lit(True))  # single rows
    out = out.withColumn("k_avg", F.try_divide(2 * F.col("m"), F.col("n")))
    if area is not None:
        for measure, name in densities:
            out = out.withColumn(name, F.col(measure) / (area / 1e6))
    return out


def bearing_histogram(edges: DataFrame, bins: int = 36, min_length: float = 0.0, weight: str | None = None, undirected: bool = True) -> DataFrame:
    """``(bin, centre, weight)`` of edge bearings; every bin has a row.

    Bins are centred on multiples of their width, so north is one bin. Self-loops,
    short edges and null bearings are left out; undirected streets count both ways.
    """
    rows = edges.where((F.col("u") != F.col("v")) & (F.col("length") >= min_length) & F.col("bearing").isNotNull())
    rows = rows.select("bearing", (F.coalesce(weight, F.lit(0.0)) if weight else F.lit(1.0)).alias("w"))
    if undirected:
        rows = rows.select(F.explode(F.array("bearing", F.pmod(F.col("bearing") - 180, F.lit(360.0)))).alias("bearing"), "w")
    half = 360.0 / (2 * bins)
    place = F.floor(((F.least(F.floor(F.col("bearing") / half), F.lit(2 * bins - 1)) + 1) % (2 * bins)) / 2).cast("int")
    have = rows.groupBy(place.alias("bin")).agg(F.sum("w").alias("weight"))
    every = edges.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(have), "bin", "left").select("bin", (F.col("bin") * (360.0 / bins)).alias("centre"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def orientation_entropy(histogram: DataFrame) -> DataFrame:
    """Entropy (natural logarithm) of the shares of the bins."""
    total = histogram.agg(F.sum("weight").alias("total"))
    p = F.try_divide(F.col("weight"), F.col("total"))
    return histogram.join(F.broadcast(total), F.lit(True)).agg((-F.sum(F.when(p > 0, p * F.ln(p)))).alias("orientation_entropy"))


def orientation_rose(histogram: DataFrame, area: bool = True) -> DataFrame:
    """Plot data: share and bar radius of each direction; with ``area`` the bar's area shows the share."""
    total = histogram.agg(F.sum("weight").alias("total"))
    share = F.coalesce(F.try_divide(F.col("weight"), F.col("total")), F.lit(0.0))
    return histogram.join(F.broadcast(total), F.lit(True)).select("bin", "centre", share.alias("share"), (F.sqrt(share) if area else share).alias("radius"))


def figure_ground(edges: DataFrame, widths: dict[str, float], default: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Plot data: line width of each edge by street type, and size of each node from its widest edge."""
    given = F.create_map(*[F.lit(x) for k, w in widths.items() for x in (k, float(w))])
    lines = edges.withColumn("width", F.coalesce(given[F.coalesce("highway", F.lit(""))], F.lit(default)))
    dots = lines.select(F.explode(F.array("u", "v")).alias("osmid"), "width").groupBy("osmid").agg(F.max("width").alias("w"))
    return lines, dots.select("osmid", (F.col("w") * F.col("w")).alias("size"))
