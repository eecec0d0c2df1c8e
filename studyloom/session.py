"""Session settings and size checks shared by all jobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Largest driver-side lookup we are willing to ship to every task.
BROADCAST_ROWS = 50_000


# Settings of the learning queries, whose joins and groupings meet tables of any size.  A table may be shipped to every task if it is at most
# 8 MB in its shuffle; files and shuffles are read in tasks of 16 MB, so the memory of a task does not follow the input.
MEASURED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "8MB",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.files.maxPartitionBytes": "16MB",
}


def tune(spark: SparkSession, measured: bool = False) -> SparkSession:
    """Turn on the runtime re-planning the jobs rely on; other partition counts stay the cluster's choice.

    With ``measured`` a join ships a table only if its shuffle showed it to be small.  An estimate from the size of compressed files, which
    knows nothing of exploded rows, may send a table of any size through the driver.  Without it the session's own values come back.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in MEASURED.items():
        held = "spark.studyloom.before." + key
        before = spark.conf.get(held, None)
        if measured and before is None:
            spark.conf.set(held, spark.conf.get(key, None) or "unset")
            spark.conf.set(key, value)
        elif not measured and before is not None:
            spark.conf.unset(held)
            spark.conf.unset(key) if before == "unset" else spark.conf.set(key, before)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the one the session names in ``spark.checkpoint.dir``, else one in the session's warehouse.

    Both are seen by all executors; a folder of one machine is never used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores if the scan has fewer splits than the cluster has cores; a large scan is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when their rows are written; else they stay until the driver happens to collect garbage.

    Only for writes and checkpoints, which are over when they return; toPandas reads its shuffles later.
    """
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialize rows that several later steps read, in the session's checkpoint folder, and cut their lineage."""
    checkpoint_dir(df.sparkSession)
    with swept(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
