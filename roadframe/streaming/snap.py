"""Streaming: windowed counts with a watermark, and positions snapped to a street graph's nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadframe.operators.nearest import nearest_nodes


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events and summed values per type and window of event time.

    In append and update mode the state of a window goes once the watermark has passed it, and later events for it
    are dropped; in complete mode Spark keeps all windows.
    """
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(frame.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def start_updates(rows: DataFrame, place: str) -> StreamingQuery:
    """Run a windowed count over all that has arrived; each batch's changed rows go to ``place/out`` with their batch number.

    A batch that runs again overwrites its own folder, so nothing counts twice. ``latest_rows`` reads the outcome.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/part-{number}")

    return rows.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()


def latest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the updates of each key the last one."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def start_snapping(positions: DataFrame, nodes: DataFrame, place: str) -> StreamingQuery:
    """Give every streamed position ``(point_id, x, y)`` its nearest node, batch by batch, into ``place/out``."""
    def snap(batch: DataFrame, number: int) -> None:
        nearest_nodes(nodes, batch).write.mode("overwrite").parquet(f"{place}/out/part-{number}")

    return positions.writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(snap).start()
