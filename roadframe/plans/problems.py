"""Queries of the data-cleaning problems over the whole of their tables, and SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframe.operators import impute, nested, packed, proximity, references, units
from roadframe.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(table(spark, d, "elements"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(table(spark, d, "elements"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.explode_packed(table(spark, d, "edges"), packed.FIELDS, ["ord"], min_members=2).select(
        "ord", "field", "pos", "item")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_found(table(spark, d, "overpass_raw"))


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Children per element type and kind, parents counted by their link."""
    rows = nested.nested_children(table(spark, d, "overpass_raw"))
    return rows.groupBy("el_type", "kind").agg(F.count(F.lit(1)).alias("children"),
                                               F.countDistinct("response_id", "el_ord").alias("parents"))


def _nested(kind: str) -> Query:
    return lambda spark, d: nested.nested_table(table(spark, d, "overpass_raw"), kind)


def _element(kind: str) -> Query:
    return lambda spark, d: nested.element_table(table(spark, d, "elements"), kind)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.foreign_speeds(table(spark, d, "edges"), table(spark, d, "extracts"))


def p5_units(spark: SparkSession, d: str) -> DataFrame:
    """All speeds with their unit, posterior and flag."""
    return units.speeds_in_metres(table(spark, d, "edges"), table(spark, d, "extracts")).select(
        "ord", "pos", "number", "unit", "m_per_h", "mixture_unit", F.round("posterior", 9).alias("posterior"), "uncertain")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.proximity_found(table(spark, d, "nodes"), table(spark, d, "elements"), table(spark, d, "areas"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return impute.group_fills(table(spark, d, "edges"), table(spark, d, "extracts"))


def p7_imputed(spark: SparkSession, d: str) -> DataFrame:
    return impute.imputed_edges(table(spark, d, "edges"), table(spark, d, "extracts"))


def p7_convergence(spark: SparkSession, d: str) -> DataFrame:
    """Fitted parameters of each round and how far they moved."""
    return impute.convergence(table(spark, d, "edges"), table(spark, d, "extracts"))


def p7_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the known values masked, filled and compared."""
    return impute.held_out(impute.edge_observations(table(spark, d, "edges"), table(spark, d, "extracts")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_report, p2_found, p3_found, p3_kinds, p5_found, p5_units,
                                                     p6_found, p7_found, p7_imputed, p7_convergence, p7_accuracy)}
QUERIES |= {f"p3_{kind}s": _nested(kind) for kind in nested.SUBTYPES} | {f"p3_element_{kind}s": _element(kind) for kind in ("tag", "node", "member")}

_CURRENT = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY version DESC NULLS LAST, ingested_at DESC NULLS LAST) rn,
          min(ingested_at) OVER (PARTITION BY type, id) first_seen FROM elements) WHERE rn = 1)"""

_P1 = f"""WITH {_CURRENT},
refs AS (SELECT DISTINCT type src_type, id src_id, ingested_at seen, 'node' ref_type, ref_id FROM
           (SELECT type, id, ingested_at, unnest(nodes) ref_id FROM cur WHERE type = 'way' AND coalesce(visible, true))
         UNION SELECT type, id, ingested_at, m.type, m.ref FROM
           (SELECT type, id, ingested_at, unnest(members) m FROM cur WHERE type = 'relation' AND coalesce(visible, true))),
judged AS (SELECT src_type, src_id, r.ref_type, r.ref_id, strftime(seen, '%Y-%m') period,
    CASE WHEN c.id IS NULL THEN 'missing' WHEN NOT coalesce(c.visible, true) THEN 'deleted'
         WHEN c.first_seen > r.seen THEN 'late' END reason
  FROM refs r LEFT JOIN cur c ON c.type = r.ref_type AND c.id = r.ref_id WHERE r.ref_type IS NOT NULL AND r.ref_id IS NOT NULL)
"""

_P6 = f"""WITH {_CURRENT},
pt AS (SELECT DISTINCT osmid, x, y FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
near AS (SELECT DISTINCT 'near' kind, a.osmid id_a, b.osmid id_b FROM pt a JOIN pt b ON a.osmid < b.osmid AND abs(a.y - b.y) < 0.0002
  AND 2 * 6371009 * asin(least(1, sqrt(power(sin(radians(b.y - a.y) / 2), 2)
      + cos(radians(a.y)) * cos(radians(b.y)) * power(sin(radians(b.x - a.x) / 2), 2)))) <= 12),
rings AS (SELECT area_id, part, unnest(p) ring FROM (SELECT area_id, unnest(polygons) p, unnest(range(len(polygons))) part FROM areas)),
edges_ AS (SELECT area_id, part, ring[i].x x1, ring[i].y y1, ring[i + 1].x x2, ring[i + 1].y y2
  FROM (SELECT area_id, part, ring, unnest(range(1, len(ring))) i FROM rings)),
am AS (SELECT id, lon, lat FROM cur WHERE type = 'node' AND coalesce(visible, true) AND tags['amenity'] IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL),
hit AS (SELECT area_id, part, id FROM am JOIN edges_ ON (y1 <= lat) <> (y2 <= lat) AND x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon
  GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
SELECT * FROM near UNION ALL SELECT DISTINCT 'inside', area_id, id FROM hit"""

SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT src_type, src_id, ref_type, ref_id, reason, period FROM judged WHERE reason IS NOT NULL",
    "p1_report": _P1 + """SELECT src_type, ref_type, reason, period, count(*) n_refs, count(DISTINCT src_id) n_sources
        FROM judged WHERE reason IS NOT NULL GROUP BY ALL""",
    "p3_element_tags": """SELECT el_type, el_id, version, extract_id, e.key tag_key, e.value tag_value FROM
        (SELECT type el_type, id el_id, version, extract_id, unnest(map_entries(tags)) e FROM elements) WHERE e.value IS NOT NULL""",
    "p3_element_nodes": """SELECT el_type, el_id, version, extract_id, pos::INTEGER pos, ref FROM
        (SELECT type el_type, id el_id, version, extract_id, unnest(nodes) AS ref, unnest(range(1, len(nodes) + 1)) pos FROM elements WHERE type = 'way') WHERE ref IS NOT NULL""",
    "p3_element_members": """SELECT el_type, el_id, version, extract_id, pos::INTEGER pos, coalesce(m.type, '') ref_type, m.ref AS ref, coalesce(m.role, '') AS role FROM
        (SELECT type el_type, id el_id, version, extract_id, unnest(members) m, unnest(range(1, len(members) + 1)) pos FROM elements WHERE type = 'relation') WHERE m.ref IS NOT NULL""",
    "p6_found": _P6,
}
