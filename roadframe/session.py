"""Shared-folder materialisation and joins that survive hot keys."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in a local session.

    On a cluster without that setting there is no safe default, so this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.getCheckpointDir():
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="roadframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_RUNS: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """This session's own folder inside the shared one; holds all its intermediates."""
    key = spark.sparkContext.applicationId
    if key not in _RUNS:
        _RUNS[key] = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
        atexit.register(_remove_local, _RUNS[key])
    return _RUNS[key]


def _remove_local(path: str) -> None:
    plain = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(plain):
        shutil.rmtree(plain, ignore_errors=True)


def release(spark: SparkSession) -> None:
    """Delete the intermediates of this session from the shared folder; results that still read them must be written first.

    A folder on a mounted disk is also deleted when the driver's process ends.
    """
    path = _RUNS.pop(spark.sparkContext.applicationId, None)
    if path is not None:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage without relying on any executor staying alive, and gives
    later joins a plain scan, so adaptive execution may split hot partitions on
    either side.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    logging.getLogger("roadframe").debug("writing %s", path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bound(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than needed to know."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcast only after its row count was checked; otherwise leave the join to shuffle."""
    return F.broadcast(df) if row_bound(df, limit) else df
