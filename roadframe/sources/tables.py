"""Readers for the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def current_elements(elements: DataFrame, *payload: str) -> DataFrame:
    """One row per (type, id): the row of highest version, among equals the latest ``ingested_at``.

    ``payload`` columns are taken from that row; ``visible`` null counts as true;
    ``first_seen`` is the earliest ``ingested_at`` of all rows of the element.
    Rows without type or id are no elements and are left out.
    """
    rank = F.struct(F.col("version"), F.col("ingested_at"))
    row = F.struct(F.coalesce("visible", F.lit(True)).alias("visible"), F.col("ingested_at"),
                   *[F.col(c) for c in payload])
    best = (elements.where(F.col("type").isNotNull() & F.col("id").isNotNull())
            .groupBy("type", "id")
            .agg(F.max_by(row, rank).alias("_row"), F.min("ingested_at").alias("first_seen")))
    return best.select("type", "id", "first_seen", "_row.*")


def current_versions(elements: DataFrame) -> DataFrame:
    """``(type, id, visible, first_seen)`` of each element, as ``current_elements`` without payload.

    The rank of a row and its visibility are packed into one decimal, so this is a
    hash aggregation on fixed-width values. Null versions and times rank lowest.
    """
    # counted from the parts of the clock reading, so that no session time zone can shift or merge hours
    at = F.col("ingested_at")
    second_of = F.extract(F.lit("SECOND"), at).cast("decimal(8,6)") * 1_000_000
    micros = (F.unix_date(at.cast("date")).cast("bigint") * 86_400_000_000 + F.hour(at).cast("bigint") * 3_600_000_000
              + F.minute(at).cast("bigint") * 60_000_000 + second_of.cast("bigint"))
    micros = F.coalesce(micros, F.lit(-(1 << 62))).cast("decimal(20,0)")
    version = F.coalesce(F.col("version"), F.lit(-(1 << 31))).cast("decimal(11,0)")
    hidden = F.when(F.coalesce("visible", F.lit(True)), 0).otherwise(1)
    second = F.lit(str(1 << 63)).cast("decimal(20,0)")
    rank = ((version * second + micros) * 2 + hidden).cast("decimal(38,0)")
    best = (elements.where(F.col("type").isNotNull() & F.col("id").isNotNull()).groupBy("type", "id")
            .agg(F.max(rank).alias("_rank"), F.min("ingested_at").alias("first_seen")))
    return best.select("type", "id", (F.pmod("_rank", F.lit(2).cast("decimal(38,0)")) == 0).alias("visible"), "first_seen")
