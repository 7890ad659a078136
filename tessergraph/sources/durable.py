"""Durable intermediates: tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, but only if all of Spark runs in this process."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessergraph-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what is run inside as soon as it has ended, where this Spark can."""
    try:
        before = spark.conf.get(_CLEANUP)
    except PySparkException:
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table as Parquet into the shared folder and reads it back, which cuts its lineage.

    A lost executor costs a rerun of its tasks, and nothing once the table is written. The shuffle files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


#: Rows of keys that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 500_000


def sized(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table that is broadcast if it has few enough rows. It is counted first, so it should be cheap to read."""
    return broadcast(keys) if keys.count() <= rows else keys


def drop_materialized(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_durable_path", None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
