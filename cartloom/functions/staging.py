"""Written intermediate tables.

Global ranks, quantiles and fitted models read an intermediate result more
than once.  It is written once below the cluster's checkpoint folder and read
back, which cuts the lineage and survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}

#: Spark's setting to delete the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind.

    Otherwise Spark removes them only once the driver's collector has found their plans
    dead, and the shuffles of all steps pile up on the executors' disks.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="cartloom-")
    return _local_roots[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/cartloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and return a reader of it; the shuffle files behind it go at once."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_go(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
