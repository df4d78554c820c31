"""Nearest node and nearest edge of query points, by rings of grid cells.

Points search the cells around their own in widening rings; a point is settled
once its best distance is at most the width that its rings have fully covered.
Unsettled points go on to the next, four times wider grid, so empty regions cost
a few rounds and dense ones never look far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframe.functions.cells import sphere_xyz
from roadframe.model import EARTH_RADIUS_M
from roadframe.session import materialize


def _cells(*values: Column) -> Column:
    return F.struct(*[F.floor(v).cast("bigint").alias(f"c{i}") for i, v in enumerate(values)])


def _around(cell: Column, axes: int) -> Column:
    """The 3^axes cells around a cell."""
    out = F.array(cell)
    for i in range(axes):
        out = F.concat(*[F.transform(out, _shift(f"c{i}", by, axes)) for by in (-1, 0, 1)])
    return out


def _shift(name: str, by: int, axes: int):
    return lambda c: F.struct(*[(c[f"c{i}"] + (by if f"c{i}" == name else 0)).alias(f"c{i}") for i in range(axes)])


def nearest_nodes(nodes: DataFrame, points: DataFrame, projected: bool = False, cell: float = 200.0) -> DataFrame:
    """``(point_id, osmid, dist)`` for rows ``(point_id, x, y)``: metres on the sphere, or planar units when projected.

    Equal distances (to a micrometre): the smallest osmid. Points without coordinates get a null node.
    """
    def place(df: DataFrame) -> DataFrame:
        usable = df.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
        if projected:
            return usable.withColumn("px", F.col("x")).withColumn("py", F.col("y")).withColumn("pz", F.lit(0.0))
        a, b, c = sphere_xyz(F.col("x"), F.col("y"))
        return usable.withColumn("px", a).withColumn("py", b).withColumn("pz", c)

    index = materialize(place(nodes).select("osmid", "px", "py", "pz"), "index")
    open_ = materialize(place(points).select("point_id", F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("pz").alias("qz")), "points")
    done = []
    axes = ("x", "y") if projected else ("x", "y", "z")
    d2 = sum((F.col(f"p{a}") - F.col(f"q{a}")) * (F.col(f"p{a}") - F.col(f"q{a}")) for a in axes)
    dist = F.sqrt(d2) if projected else 2 * EARTH_RADIUS_M * F.asin(F.least(F.sqrt(d2) / (2 * EARTH_RADIUS_M), F.lit(1.0)))
    empty = index.isEmpty()
    while not empty and not open_.isEmpty():
        size = cell
        keyed = index.withColumn("cell", _cells(*[F.col(f"p{a}") / size for a in axes]))
        probes = open_.withColumn("cell", F.explode(_around(_cells(*[F.col(f"q{a}") / size for a in axes]), len(axes))))
        best = probes.join(keyed, "cell").groupBy("point_id").agg(F.min(F.struct(F.round(dist, 6).alias("near"), F.col("osmid"), dist.alias("dist"), d2.alias("d2"))).alias("b"))
        found = materialize(open_.join(best, "point_id", "left").select(*open_.columns, "b.d2", "b.osmid", "b.dist"), "found")
        settled = F.coalesce(F.sqrt("d2") <= size, F.lit(False))
        done.append(found.where(settled).select("point_id", "osmid", "dist"))
        open_ = found.where(~settled).select(*open_.columns)
        cell *= 4
    out = points.select("point_id")
    if not done:
        return out.withColumn("osmid", F.lit(None).cast("bigint")).withColumn("dist", F.lit(None).cast("double"))
    hits = done[0]
    for part in done[1:]:
        hits = hits.unionByName(part)
    return out.join(hits, "point_id", "left")


def nearest_edges(edges: DataFrame, points: DataFrame, cell: float = 0.002) -> DataFrame:
    """``(point_id, u, v, key, dist)``: planar distance to the edge's ``geometry`` in coordinate units, whatever they are.

    Every segment is listed in the cells its box touches, on a grid as coarse as it is long; equal distances (to ten decimals): the smallest (u, v, key).
    """
    legs = F.zip_with(F.slice("geometry", 1, F.size("geometry") - 1), F.slice("geometry", 2, F.size("geometry") - 1),
                      lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    segments = materialize(edges.where(F.size("geometry") >= 2).select("u", "v", "key", F.explode(legs).alias("s")).select("u", "v", "key", "s.*"), "segments")
    usable = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    open_ = materialize(usable.select("point_id", F.col("x").alias("qx"), F.col("y").alias("qy")), "points")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.coalesce(F.try_divide((F.col("qx") - F.col("ax")) * dx + (F.col("qy") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
    ex, ey = F.col("ax") + t * dx - F.col("qx"), F.col("ay") + t * dy - F.col("qy")
    dist = F.sqrt(ex * ex + ey * ey)
    done = []
    empty = segments.isEmpty()
    while not empty and not open_.isEmpty():
        # a segment is listed on the level whose cells are at least as long as it is: in four cells at most
        extent = F.greatest(F.abs(dx), F.abs(dy))
        level = F.when(extent > cell, F.ceil(F.log(4.0, extent / cell))).otherwise(0).cast("int")
        sized = segments.withColumn("level", level).withColumn("size", F.pow(F.lit(4.0), "level") * cell)
        span = lambda a, b: F.sequence(F.floor(F.least(a, b) / F.col("size")), F.floor(F.greatest(a, b) / F.col("size")))
        keyed = sized.withColumn("i", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("j", F.explode(span(F.col("ay"), F.col("by"))))
        levels = [r["level"] for r in sized.select("level").distinct().collect()]  # levels of powers of four: a dozen at most
        # a point settles within one cell, so it looks that far on every level: coarse levels need one cell or two
        near = lambda q: F.sequence(F.floor((q - cell) / F.col("size")), F.floor((q + cell) / F.col("size")))
        probes = open_.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("size", F.pow(F.lit(4.0), "level") * cell).drop("level")
        probes = probes.withColumn("i", F.explode(near(F.col("qx")))).withColumn("j", F.explode(near(F.col("qy"))))
        best = probes.join(keyed, ["size", "i", "j"]).where(dist <= cell).groupBy("point_id").agg(F.min(F.struct(F.round(dist, 10).alias("near"), "u", "v", "key", dist.alias("dist"))).alias("b"))
        found = materialize(open_.join(best, "point_id", "left").select(*open_.columns, "b.dist", "b.u", "b.v", "b.key"), "found")
        settled = F.coalesce(F.col("dist") <= cell, F.lit(False))
        done.append(found.where(settled).select("point_id", "u", "v", "key", "dist"))
        open_ = found.where(~settled).select(*open_.columns)
        cell *= 4
    out = points.select("point_id")
    if not done:
        return out.select("point_id", *[F.lit(None).cast(t).alias(c) for c, t in (("u", "bigint"), ("v", "bigint"), ("key", "int"), ("dist", "double"))])
    hits = done[0]
    for part in done[1:]:
        hits = hits.unionByName(part)
    return out.join(hits, "point_id", "left")
