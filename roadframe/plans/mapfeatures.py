"""Queries of the map-feature operators and of the stream, with their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframe.operators import build, entry, features
from roadframe.plans.base import CURRENT_SQL, haversine
from roadframe.session import run_dir
from roadframe.sources.tables import current_elements, table
from roadframe.streaming.snap import latest_rows, start_updates, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = "WITH " + CURRENT_SQL


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_TAGS: dict[str, bool | str | list[str]] = {"amenity": True, "highway": ["crossing", "stop"], "building": "yes", "shop": False}
_TAGS_SQL = "(tags['amenity'] IS NOT NULL OR coalesce(tags['highway'] IN ('crossing', 'stop'), false) OR coalesce(tags['building'] = 'yes', false))"


@query(C + f" SELECT type element, id FROM cur WHERE {_TAGS_SQL}")
def features_tag_or(spark: SparkSession, d: str) -> DataFrame:
    return features.current_features(table(spark, d, "elements"), _TAGS).select("element", "id")


@query(C + f" SELECT tag, count(*)::BIGINT n FROM (SELECT unnest(map_keys(tags)) tag FROM cur WHERE {_TAGS_SQL}) GROUP BY tag")
def features_tag_columns(spark: SparkSession, d: str) -> DataFrame:
    return features.used_tag_keys(features.current_features(table(spark, d, "elements"), _TAGS))


_SHAPE = [[(-120.0, -50.0), (150.0, -50.0), (150.0, 60.0), (-120.0, 60.0), (-120.0, -50.0)], [(-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (-10.0, 10.0), (-10.0, -10.0)]]


@query(C + " SELECT osmid id FROM en WHERE tags['amenity'] IS NOT NULL AND x BETWEEN -120 AND 150 AND y BETWEEN -50 AND 60 AND NOT (x BETWEEN -10 AND 10 AND y BETWEEN -10 AND 10)")
def features_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(table(spark, d, "elements").where(F.col("type") == "node"), "lat", "lon", "tags").where("visible AND lat IS NOT NULL AND lon IS NOT NULL")
    points = rows.select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "tags")
    return features.features_in_polygon(points, _SHAPE, {"amenity": True}).select("id")


@query("""SELECT type element, id, extract_id FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY ingested_at, version, extract_id) rn,
    rank() OVER (PARTITION BY type, id ORDER BY ingested_at, version, extract_id) FROM elements) WHERE rn = 1""")
def features_first_seen(spark: SparkSession, d: str) -> DataFrame:
    first = F.min(F.struct("ingested_at", "version", "extract_id")).alias("f")
    return table(spark, d, "elements").groupBy(F.col("type").alias("element"), "id").agg(first).select("element", "id", F.col("f.extract_id").alias("extract_id"))


def _any(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_AREA = ("coalesce(tags['area'] <> 'no', true) AND (" + " OR ".join(
    [f"tags['{k}'] IS NOT NULL" for k in features.AREA_KEYS] + [f"coalesce(tags['{k}'] IN {_any(v)}, false)" for k, v in features.AREA_WITH.items()]
    + [f"coalesce(tags['{k}'] NOT IN {_any(v)}, false)" for k, v in features.AREA_WITHOUT.items()]) + ")")
_LINES = f"""{C}, w AS (SELECT osmid id, tags, list_filter(refs, lambda n, i: i = 1 OR n <> refs[i - 1]) r FROM ew),
wk AS (SELECT id, r, CASE WHEN len(r) >= 4 AND r[1] = r[-1] AND {_AREA} THEN 'Polygon' ELSE 'LineString' END kind FROM w WHERE len(r) > 0),
p AS (SELECT id, i, x, y FROM (SELECT id, unnest(r) ref, unnest(range(len(r))) i FROM wk) LEFT JOIN en ON en.osmid = ref),
seg AS (SELECT id, x, y, lead(x) OVER (PARTITION BY id ORDER BY i) x2, lead(y) OVER (PARTITION BY id ORDER BY i) y2 FROM p)"""


def _ways(spark: SparkSession, d: str) -> DataFrame:
    elements = table(spark, d, "elements")
    return features.way_geometry(build.current_ways(elements, custom_filter=['["highway"]', '["highway"!~"."]']), build.current_nodes(elements))


@query(_LINES + " SELECT id, kind FROM wk")
def way_polygon_rule(spark: SparkSession, d: str) -> DataFrame:
    return _ways(spark, d).select("id", "kind")


@query(_LINES + f""" SELECT id, round(sum({haversine('y', 'x', 'y2', 'x2')}), 2) AS length FROM seg
    WHERE id IN (SELECT id FROM p GROUP BY id HAVING count(*) >= 2 AND count(*) = count(x)) AND x2 IS NOT NULL GROUP BY id""")
def way_geometry(spark: SparkSession, d: str) -> DataFrame:
    from roadframe.functions.geo import line_length

    return _ways(spark, d).where("points IS NOT NULL").select("id", F.round(line_length(F.col("points")), 2).alias("length"))


_FEATURE_TAGS: dict[str, bool | str | list[str]] = {"amenity": True, "building": True, "landuse": True, "highway": True}


@query()
def features_from_polygon(spark: SparkSession, d: str) -> DataFrame:
    return entry.features_from_polygon(table(spark, d, "elements"), _SHAPE, _FEATURE_TAGS).select("element", "id")


@query(_LINES + f""", box AS (SELECT -60.0 x0, -40.0 y0, 60.0 x1, 45.0 y1),
g AS (SELECT id, kind FROM wk JOIN (SELECT id FROM p GROUP BY id HAVING count(*) >= 2 AND count(*) = count(x)) USING (id)),
cr AS (SELECT seg.id, x, y, x2, y2, x0, y0, x1, y1, (x2 - x) * (y0 - y) - (y2 - y) * (x0 - x) a, (x2 - x) * (y0 - y) - (y2 - y) * (x1 - x) b,
    (x2 - x) * (y1 - y) - (y2 - y) * (x0 - x) c, (x2 - x) * (y1 - y) - (y2 - y) * (x1 - x) d FROM seg, box WHERE x2 IS NOT NULL),
met AS (SELECT id FROM cr WHERE greatest(x, x2) >= x0 AND least(x, x2) <= x1 AND greatest(y, y2) >= y0 AND least(y, y2) <= y1 AND least(a, b, c, d) <= 0 AND greatest(a, b, c, d) >= 0),
around AS (SELECT id FROM cr WHERE (y <= y0) <> (y2 <= y0) AND x + (y0 - y) / (y2 - y) * (x2 - x) > x0 GROUP BY id HAVING count(*) % 2 = 1)
SELECT 'node' element, osmid id FROM en WHERE x BETWEEN -60 AND 60 AND y BETWEEN -40 AND 45 AND (tags['building'] IS NOT NULL OR tags['highway'] IS NOT NULL)
UNION ALL SELECT 'way', id FROM g JOIN w USING (id) WHERE (tags['building'] IS NOT NULL OR tags['highway'] IS NOT NULL)
  AND (id IN (SELECT id FROM met) OR (kind = 'Polygon' AND id IN (SELECT id FROM around)))""")
def features_from_bbox(spark: SparkSession, d: str) -> DataFrame:
    return entry.features_from_bbox(table(spark, d, "elements"), (-60.0, -40.0, 60.0, 45.0), {"building": True, "highway": True}).select("element", "id")


@query()
def relation_geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(table(spark, d, "elements").where(F.col("type") == "relation"), "members", "tags").where("visible")
    return features.relation_geometry(rows, _ways(spark, d).select("id", "points"))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT n, round(sum(value), 4) total FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The event file as a stream in one available-now run; updates are kept in the shared folder."""
    static = table(spark, d, "events")
    place = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(static.schema)
    if os.path.isfile(f"{d}/events.parquet"):  # a stream reads folders: pick the one file out of its folder
        source = reader.option("pathGlobFilter", "events.parquet").parquet(d)
    else:
        source = reader.parquet(f"{d}/events.parquet")
    start_updates(windowed_counts(source.withColumn("ts", F.col("ts").cast("timestamp"))), place).awaitTermination()
    rows = latest_rows(spark.read.parquet(f"{place}/out/*"), ["start", "event_type"])
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
