"""Tables that grow by whole segments.

Every append writes one segment under a name of its own and then a one-row note that makes it count, so a reader sees whole segments only
and a repeated append replaces itself.  Tables are cut into folders (buckets) by what they are looked up by and sorted inside a bucket.
Buckets are written by as many tasks as their size asks for, so a frequent key is no single task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Folders a table is cut into; up to 32 are listed by the driver itself.
BUCKETS = 32
NOTE = "version string, segment string, replaces array<string>"


def bucket_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


class Segments:
    """Segments of the tables in ``TABLES`` (name -> schema, the last column being the bucket) under ``root``.

    Notes and file lists are read once; ``refresh`` makes later changes by others visible.
    """

    TABLES: dict[str, str] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.refresh()

    def refresh(self) -> None:
        self._noted: list[dict] | None = None
        self._frames: dict[tuple[str, str], DataFrame] = {}

    def _write(self, segment: str, table: str, rows: DataFrame, keys: list[str], order: list[str]) -> None:
        dealt = rows.withColumn("bucket", bucket_of(*keys)).hint("rebalance", "bucket")
        (dealt.sortWithinPartitions("bucket", *keys, *order).write.option("compression", "zstd").option("parquet.block.size", 16 << 20)
         .partitionBy("bucket").parquet(f"{self.root}/{segment}/{table}"))

    def _note(self, version: str, segment: str, replaces: list[str]) -> None:
        note = self.spark.createDataFrame([(version, segment, replaces)], NOTE)
        note.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_notes/{uuid.uuid5(uuid.NAMESPACE_OID, version).hex}")
        self.refresh()

    def _notes(self) -> list[dict]:
        """Notes that count: one small row a version, less those that a later one replaces."""
        if self._noted is None:
            self._noted = self._read_notes()
        return self._noted

    def _read_notes(self) -> list[dict]:
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_notes")
        if not files.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
            return []
        notes = [r.asDict() for r in self.spark.read.schema(NOTE).parquet(f"{self.root}/_notes/*").collect()]
        gone = {v for n in notes for v in n["replaces"]}
        return [n for n in notes if n["version"] not in gone]

    def versions(self) -> list[str]:
        return sorted(n["version"] for n in self._notes())

    def _of(self, segment: str, table: str) -> DataFrame:
        if (segment, table) not in self._frames:
            self._frames[segment, table] = self.spark.read.schema(self.TABLES[table]).parquet(f"{self.root}/{segment}/{table}")
        return self._frames[segment, table]

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all segments, of some buckets only."""
        parts = [self._of(n["segment"], name) for n in self._notes()]
        total = parts[0] if parts else self.spark.createDataFrame([], self.TABLES[name])
        for more in parts[1:]:
            total = total.unionByName(more)
        return total if buckets is None else total.where(F.col("bucket").isin(buckets))

    def lookup(self, name: str, wanted: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        """Rows of a table with keys in ``wanted``: reads the folders of the wanted buckets, of which there are at most BUCKETS."""
        buckets = sorted(r["bucket"] for r in wanted.select(bucket_of(*keys).alias("bucket")).distinct().collect())
        return self.table(name, buckets).select(*keys, *columns).join(wanted.select(*keys).distinct(), keys, "left_semi")
