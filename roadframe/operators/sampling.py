"""Length-weighted sampling of points along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: Edges per bucket that are aimed at beyond that.
BUCKET_EDGES = 100_000


def sample_points(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``(sample, u, v, key, x, y)``: n points, edges chosen with replacement in proportion to length, places uniform along them.

    Cumulative lengths are built from the sums of hashed buckets and running sums
    inside each, so no task sees all edges. Edges need ``geometry`` and a positive length.
    """
    from roadframe.functions.geo import euclidean

    usable = edges.where("length > 0 AND size(geometry) >= 2")
    buckets = max(BUCKETS, usable.count() // BUCKET_EDGES)
    rows = usable.withColumn("b", F.pmod(F.xxhash64("u", "v", "key"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("b").agg(F.sum("length").alias("s"))
    running = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    ends = sums.withColumn("lo", F.coalesce(F.sum("s").over(running), F.lit(0.0)))
    total = sums.agg(F.sum("s").alias("total"))
    draws = edges.sparkSession.range(n).select(F.col("id").alias("sample"), F.rand(seed).alias("r"), F.rand(seed + 1).alias("along"))
    placed = draws.join(F.broadcast(total), F.lit(True)).withColumn("t", F.col("r") * F.col("total"))
    spans = ends.agg(F.array_sort(F.collect_list(F.struct("lo", "b", "s"))).alias("spans"))
    placed = placed.join(F.broadcast(spans), F.lit(True))
    hit = F.element_at(F.filter("spans", lambda x: x["lo"] <= F.col("t")), -1)
    placed = placed.select("sample", "along", hit["b"].alias("b"), (F.col("t") - hit["lo"]).alias("t"))
    inside = Window.partitionBy("b").orderBy("u", "v", "key").rowsBetween(Window.unboundedPreceding, 0)
    lines = rows.withColumn("hi", F.sum("length").over(inside)).withColumn("lo", F.col("hi") - F.col("length"))
    chosen = placed.join(lines, "b").where((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi")))
    legs = F.zip_with(F.slice("geometry", 1, F.size("geometry") - 1), F.slice("geometry", 2, F.size("geometry") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q"), euclidean(p["y"], p["x"], q["y"], q["x"]).alias("d")))
    whole = F.aggregate("legs", F.lit(0.0), lambda a, x: a + x["d"])
    chosen = chosen.withColumn("legs", legs).withColumn("target", F.col("along") * whole)
    walk = F.aggregate("legs", F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("struct<x:double,y:double>").alias("at")), lambda a, x: F.struct(
        (a["s"] + x["d"]).alias("s"), F.coalesce(a["at"], F.when(a["s"] + x["d"] >= F.col("target"), F.struct(
            (x["p"]["x"] + F.coalesce(F.try_divide(F.col("target") - a["s"], x["d"]), F.lit(0.0)) * (x["q"]["x"] - x["p"]["x"])).alias("x"),
            (x["p"]["y"] + F.coalesce(F.try_divide(F.col("target") - a["s"], x["d"]), F.lit(0.0)) * (x["q"]["y"] - x["p"]["y"])).alias("y")))).alias("at")))
    return chosen.withColumn("_w", walk).select("sample", "u", "v", "key", F.col("_w.at.x").alias("x"), F.col("_w.at.y").alias("y"))
