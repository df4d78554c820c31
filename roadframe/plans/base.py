"""The graph that registered queries run on, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframe.functions.geo import parse_wkt_line
from roadframe.model import StreetGraph
from roadframe.sources.tables import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per node with a place; of repeated rows the smallest values."""
    rows = table(spark, d, "nodes").where("osmid IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    known = F.when(~F.isnan("elevation"), F.col("elevation"))
    return rows.groupBy("osmid").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min(known).alias("elevation"), F.min("highway").alias("highway"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """One row per (u, v, key), the first loaded by ``ord``, whose both ends are nodes with a place."""
    rows = table(spark, d, "edges").where("u IS NOT NULL AND v IS NOT NULL AND key IS NOT NULL")
    rest = ["ord", "osmid", "highway", "maxspeed", "oneway", "reversed", "length", "geom_wkt"]
    one = rows.groupBy("u", "v", "key").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("u", "v", "key", "r.*")
    ids = nodes(spark, d).select("osmid")
    return one.join(ids.withColumnRenamed("osmid", "u"), "u", "left_semi").join(ids.withColumnRenamed("osmid", "v"), "v", "left_semi").select("u", "v", "key", *rest)


def graph(spark: SparkSession, d: str, geometry: bool = False) -> StreetGraph:
    lines = edges(spark, d)
    if geometry:
        lines = lines.withColumn("geometry", parse_wkt_line(F.col("geom_wkt")))
    return StreetGraph(nodes(spark, d), lines)


GRAPH_SQL = """
gn AS (SELECT osmid, min(x) x, min(y) y, min(CASE WHEN NOT isnan(elevation) THEN elevation END) elevation, min(highway) highway
  FROM nodes WHERE osmid IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) GROUP BY osmid),
ge AS (SELECT u, v, key, ord, osmid, highway, maxspeed, oneway, reversed, length, geom_wkt FROM
  (SELECT *, row_number() OVER (PARTITION BY u, v, key ORDER BY ord) rn FROM edges WHERE u IS NOT NULL AND v IS NOT NULL AND key IS NOT NULL)
  WHERE rn = 1 AND u IN (SELECT osmid FROM gn) AND v IN (SELECT osmid FROM gn)),
gx AS (SELECT e.*, a.x ux, a.y uy, b.x vx, b.y vy, a.elevation ue, b.elevation ve FROM ge e JOIN gn a ON a.osmid = e.u JOIN gn b ON b.osmid = e.v)"""

CURRENT_SQL = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY version DESC NULLS LAST, ingested_at DESC NULLS LAST) rn FROM elements)
  WHERE rn = 1 AND coalesce(visible, true)),
en AS (SELECT id osmid, lon x, lat y, tags FROM cur WHERE type = 'node' AND lat IS NOT NULL AND lon IS NOT NULL),
ew AS (SELECT id osmid, list_filter(nodes, lambda n: n IS NOT NULL) refs, tags FROM cur WHERE type = 'way' AND nodes IS NOT NULL)"""


def haversine(y1: str, x1: str, y2: str, x2: str) -> str:
    return (f"(2 * 6371009 * asin(sqrt(least(1, power(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * power(sin(radians({x2} - {x1}) / 2), 2)))))")


def bearing_sql(y1: str, x1: str, y2: str, x2: str) -> str:
    angle = (f"degrees(atan2(sin(radians({x2} - {x1})) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians({x2} - {x1}))))")
    return f"((({angle} % 360) + 360) % 360)"
