"""Graph forms: one edge per pair, undirected streets, geometry, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadframe.model import StreetGraph, ValidationError
from roadframe.operators.build import with_endpoints
from roadframe.session import materialize


def to_digraph(edges: DataFrame, weight: str = "length") -> DataFrame:
    """The edge of least weight per (u, v); equal weights: the smallest key; a missing weight counts as 1."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    best = F.min_by(F.struct(*rest), F.struct(F.coalesce(weight, F.lit(1.0)), "key"))
    return edges.groupBy("u", "v").agg(best.alias("_r")).select("u", "v", *[f"_r.{c}" for c in rest])


def edge_points(graph: StreetGraph, fill: bool = True) -> DataFrame:
    """Edges with ``geometry`` as an array of points; with ``fill`` a straight line where none is given."""
    edges = graph.edges if "geometry" in graph.edges.columns else graph.edges.withColumn("geometry", F.lit(None).cast("array<struct<x:double,y:double>>"))
    if not fill:
        return edges
    ends = with_endpoints(edges, graph.nodes, "x", "y")
    straight = F.array(F.struct(F.col("u_x").alias("x"), F.col("u_y").alias("y")), F.struct(F.col("v_x").alias("x"), F.col("v_y").alias("y")))
    return ends.withColumn("geometry", F.coalesce("geometry", straight)).drop("u_x", "u_y", "v_x", "v_y")


def undirected_shape(points: Column) -> Column:
    """The points in the smaller of their two orders: equal for one line drawn either way."""
    return F.least(points, F.reverse(points))


def to_undirected(graph: StreetGraph) -> DataFrame:
    """Streets without their reciprocal twins: ``(u, v, key, from, to, ...)`` with u <= v; ``from`` and ``to`` keep the direction.

    Two directions of a pair that share a key are one street when their lines are the same read either way (straight
    where none is given); otherwise the first of them gets a new key above all keys of the pair. Then, of
    a pair's streets with one way id (lists compare as sets) and one line, the one with the smallest key stays. Of
    merged rows the first speaks. First means by ``ord`` where there is such a column, else by (key, u, v).
    """
    lines = edge_points(graph)
    rest = [c for c in lines.columns if c not in ("u", "v", "key")]
    listed = dict(lines.dtypes)["osmid"].startswith("array")
    same_way = F.array_sort(F.array_distinct("osmid")) if listed else F.col("osmid")
    rows = lines.withColumn("_a", F.least("u", "v")).withColumn("_b", F.greatest("u", "v")).withColumn("_g", undirected_shape(F.col("geometry")))
    row = F.struct("u", "v", *rest, same_way.alias("_w"), "_g")
    rank = F.struct("ord", "u") if "ord" in lines.columns else F.struct("key", "u", "v")
    both = materialize(rows.groupBy("_a", "_b", "key").agg(F.min_by(row, rank).alias("_r"), F.max_by(row, rank).alias("_l"), (F.min("_g") != F.max("_g")).alias("_apart")), "twins")
    twins = both.where("_apart").select("_a", "_b", "key")
    top = rows.groupBy("_a", "_b").agg(F.max("key").alias("_top"))
    # only pairs with bowed-out twins are numbered
    number = F.row_number().over(Window.partitionBy("_a", "_b").orderBy("key"))
    fresh = twins.withColumn("_n", number).join(top, ["_a", "_b"]).select("_a", "_b", "key", (F.col("_top") + F.col("_n")).cast("int").alias("_new"))
    kept = both.where("NOT _apart").select("_a", "_b", "key", "_r").unionByName(both.where("_apart").select("_a", "_b", "key", F.col("_l").alias("_r")))
    moved = both.where("_apart").join(fresh, ["_a", "_b", "key"]).select("_a", "_b", F.col("_new").alias("key"), "_r")
    streets = kept.unionByName(moved).groupBy("_a", "_b", F.col("_r._w").alias("_w"), F.col("_r._g").alias("_g")).agg(F.min_by(F.struct("key", "_r"), "key").alias("_s"))
    return streets.select(F.col("_a").alias("u"), F.col("_b").alias("v"), F.col("_s.key").alias("key"), F.col("_s._r.u").alias("from"), F.col("_s._r.v").alias("to"),
                          *[F.col(f"_s._r.{c}").alias(c) for c in rest])


def route_edges(routes: DataFrame, edges: DataFrame, weight: str = "length") -> DataFrame:
    """``(route_id, pos, u, v, key, <weight>)`` of the cheapest edge of each step of a ``nodes`` array."""
    steps = F.zip_with(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))), F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("u"), b.alias("v")))
    legs = routes.where("nodes IS NOT NULL").select("route_id", F.posexplode(steps).alias("pos", "_s")).select("route_id", "pos", "_s.u", "_s.v")
    return legs.join(to_digraph(edges, weight), ["u", "v"]).select("route_id", "pos", "u", "v", "key", weight)


def route_lines(routes: DataFrame, graph: StreetGraph, weight: str = "length") -> DataFrame:
    """``(route_id, line)``: the points that each route runs through, along the lines of its edges."""
    lines = edge_points(graph).select("u", "v", "key", "geometry")
    steps = route_edges(routes, graph.edges, weight).join(lines, ["u", "v", "key"]).select("route_id", F.struct("pos", "geometry").alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list("s")), lambda s, i: F.when(i == 0, s["geometry"]).otherwise(F.slice(s["geometry"], 2, F.greatest(F.size(s["geometry"]) - 1, F.lit(0)))))
    return steps.groupBy("route_id").agg(F.flatten(ordered).alias("line"))  # one route's edges


def validate_features(features: DataFrame) -> DataFrame:
    """``(rule, violations)`` of a table ``(element, id, tags)``: known elements, ids, unique pairs of both, tags."""
    rows = features.agg(F.count_if(F.col("element").isNull() | ~F.col("element").isin("node", "way", "relation")).alias("element_unknown"), F.count_if(F.col("id").isNull()).alias("feature_without_id"),
                        F.count_if(F.coalesce(F.size("tags"), F.lit(0)) < 1).alias("feature_without_tags"))
    twice = features.groupBy("element", "id").count().where("count > 1").agg(F.count(F.lit(1)).alias("feature_repeated"))
    return _rules(rows).unionByName(_rules(twice))


def _rules(counts: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("bigint").alias("violations")) for c in counts.columns])
    return counts.select(F.explode(each).alias("_x")).select("_x.*")


def validate_graph(graph: StreetGraph) -> DataFrame:
    """``(rule, violations)``: one aggregation over the nodes, one over the edges, one each for uniqueness and references."""
    n, e = graph.nodes, graph.edges
    nodes = n.agg(F.count_if(F.col("osmid").isNull()).alias("node_without_id"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("node_without_place"))
    edges = e.agg(F.count_if(F.col("u").isNull() | F.col("v").isNull() | F.col("key").isNull()).alias("edge_without_id"),
                  F.count_if(F.col("length").isNull() | (F.col("length") < 0)).alias("edge_without_length"), F.count_if(F.col("osmid").isNull()).alias("edge_without_way"))
    twice_n = n.groupBy("osmid").count().where("count > 1").agg(F.count(F.lit(1)).alias("node_repeated"))
    twice_e = e.groupBy("u", "v", "key").count().where("count > 1").agg(F.count(F.lit(1)).alias("edge_repeated"))
    ends = e.select(F.explode(F.array("u", "v")).alias("osmid")).where("osmid IS NOT NULL").distinct()
    loose = ends.join(n.select("osmid"), "osmid", "left_anti").agg(F.count(F.lit(1)).alias("edge_end_unknown"))
    out = _rules(nodes)
    for part in (edges, twice_n, twice_e, loose):
        out = out.unionByName(_rules(part))
    return out


def require_valid(graph: StreetGraph) -> None:
    if "crs" not in graph.attrs:
        raise ValidationError("the graph has no crs")
    missing = {"osmid", "x", "y"} - set(graph.nodes.columns) | {"u", "v", "key", "osmid", "length"} - set(graph.edges.columns)
    if missing:
        raise ValidationError(f"columns are missing: {sorted(missing)}")
    broken = [r["rule"] for r in validate_graph(graph).where("violations > 0").collect()]  # one row per rule
    if broken:
        raise ValidationError(f"rules broken: {broken}")


def require_numeric(edges: DataFrame, attribute: str, strict: bool = True) -> None:
    """The attribute exists, is numeric, and (when strict) never null."""
    kind = dict(edges.dtypes).get(attribute)
    if kind is None or kind.startswith(("string", "array", "map", "struct", "boolean")):
        raise ValidationError(f"{attribute} is not a numeric edge attribute")
    if strict and not edges.where(F.col(attribute).isNull()).isEmpty():
        raise ValidationError(f"{attribute} is null on some edges")
