"""Queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadframe.llm import canonical, groups, packing, tokenize
from roadframe.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.connected_groups(table(spark, d, "edges"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(packing.pack_documents(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.lookalike_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Look-alikes as one row per document: its class, its variant and its number of links."""
    return canonical.lookalike_classes(table(spark, d, "documents"))


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_documents(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p4_found, p8_ids, p9_containers, p9_report, p10_found, p10_classes, p10_canonical)}

SQL: dict[str, str] = {
    "p4_found": """WITH RECURSIVE links AS (
          SELECT u a, v b FROM edges WHERE u IS NOT NULL AND v IS NOT NULL
          UNION SELECT v, u FROM edges WHERE u IS NOT NULL AND v IS NOT NULL),
        best(osmid, group_id) USING KEY (osmid) AS (
          SELECT a, least(a, min(b)) FROM links GROUP BY a
          UNION
          SELECT l.b, min(n.group_id) FROM best n JOIN links l ON l.a = n.osmid
            JOIN recurring.best o ON o.osmid = l.b WHERE n.group_id < o.group_id GROUP BY l.b)
        SELECT osmid, group_id FROM best""",
}
