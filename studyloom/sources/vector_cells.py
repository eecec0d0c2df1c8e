"""Stored cells of vectors: every owner's unit vectors by nearest centre, with the angle that a cell reaches from its centre.

A cell's best possible cosine with a question follows from centre and reach alone, so most cells of a large owner are never read.  Centres are
vectors of the owner drawn by hash, about the root of their number.  Large owners are dealt to blocks of bounded size for the assignment,
large cells to parts.
"""

from __future__ import annotations

from collections.abc import Iterator
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from studyloom.operators.numbering import fresh, unfold
from studyloom.sources.segments import Segments

# Centres of an owner at most; vectors that are compared with all centres at once; vectors of a part of a cell, about.
MOST_CENTRES, BLOCK, PART = 4096, 4096, 2048
SPAN = 1 << 30


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def units(vectors: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """``keep``, dim and unit vectors; null, zero and empty vectors and those with null or non-finite components have none."""
    real = F.col(vector).cast("array<double>")
    fine = F.forall(real, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(vector).isNotNull() & fine & F.exists(real, lambda x: x != 0)).select(*keep, F.size(real).alias("dim"), real.alias("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("dim").to_numpy()
            flat = pc.list_flatten(b.column("unit")).to_numpy()
            first = np.cumsum(size) - size
            scale = np.repeat(np.maximum.reduceat(np.abs(flat), first), size) if len(flat) else flat
            flat = flat / scale if len(flat) else flat  # components of any size: their squares neither vanish nor overflow
            length = np.sqrt(np.add.reduceat(flat * flat, first)) if len(flat) else flat
            unit = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), pa.array(flat / np.repeat(length, size)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keep, "dim")], unit], [*keep, "dim", "unit"])

    return rows.mapInArrow(run, rows.schema)


def _assign(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Nearest centre of every vector of a block; equally near ones by number."""
    width = key[1].as_py()
    right = right.sort_by("cell")
    cosine = matrix(left["unit"], width) @ matrix(right["unit"], width).T if left.num_rows else np.zeros((0, 1))
    best = cosine.argmax(axis=1)
    angle = np.arccos(np.clip(cosine[np.arange(len(best)), best], -1, 1))
    return pa.table({"owner_id": left["owner_id"], "dim": left["dim"], "cell": right["cell"].take(pa.array(best)), "chunk_id": left["chunk_id"], "unit": left["unit"], "angle": pa.array(angle)})


class VectorCells(Segments):
    """The cells under ``root``; a cell is named by the chunk of its centre."""

    TABLES = {
        "centres": "owner_id long, dim int, cell long, segment string, unit array<double>, reach double, vectors long, parts int, bucket int",
        "members": "owner_id long, dim int, cell long, segment string, part int, chunk_id long, unit array<double>, bucket int",
    }

    def append(self, vectors: DataFrame, version: str, replaces: list[str] | None = None) -> None:
        """Cells of ``vectors`` (owner_id, chunk_id, embedding) as one segment.  The same version again replaces what it wrote before."""
        segment = f"segment-{uuid.uuid4().hex}"
        rows = units(vectors.where("owner_id is not null and chunk_id is not null").selectExpr("cast(owner_id as long) as owner_id", "cast(chunk_id as long) as chunk_id", "embedding"),
                     ["owner_id", "chunk_id"], "embedding")
        key = ["owner_id", "dim"]
        spot = F.pmod(F.xxhash64("chunk_id"), F.lit(SPAN))
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by("chunk_id", F.struct(spot, F.col("chunk_id"))).alias("always"))
        sizes = sizes.select(*key, "always", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.least(F.lit(MOST_CENTRES), F.ceil(F.sqrt("n"))).alias("wanted"))
        dealt = rows.join(sizes, key)
        drawn = dealt.where((spot * F.col("n") < F.col("wanted") * SPAN) | (F.col("chunk_id") == F.col("always")))
        centres = drawn.groupBy(*key, F.col("chunk_id").alias("cell")).agg(F.first("unit").alias("unit"), F.first("blocks").alias("blocks"))
        block = F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.col("blocks")).cast("int")
        left = dealt.select(*key, block.alias("block"), "chunk_id", "unit")
        right = unfold(centres, [*key, "cell", "unit"], F.sequence(F.lit(0), F.col("blocks") - 1), "_i", "block").drop("_i")
        assigned = left.groupBy(*key, "block").cogroup(fresh(right).groupBy(*key, "block")).applyInArrow(_assign, "owner_id long, dim int, cell long, chunk_id long, unit array<double>, angle double")
        held = assigned.withColumn("segment", F.lit(segment)).withColumn("part", F.pmod(F.xxhash64("chunk_id", F.lit(2)), F.lit(BLOCK)).cast("int"))
        self._write(segment, "members", held, ["owner_id", "cell"], ["part", "chunk_id"])
        # How far a cell reaches and how many parts it has is known only now; members keep a fine number that parts are made of.
        written = self.spark.read.schema("owner_id long, dim int, cell long, angle double, bucket int").parquet(f"{self.root}/{segment}/members")
        reach = written.groupBy(*key, "cell").agg(F.max("angle").alias("reach"), F.count(F.lit(1)).alias("vectors"), F.least(F.lit(BLOCK), F.ceil(F.count(F.lit(1)) / PART)).cast("int").alias("parts"))
        self._write(segment, "centres", centres.drop("blocks").join(reach, [*key, "cell"]).withColumn("segment", F.lit(segment)), ["owner_id"], ["cell"])
        self._note(version, segment, replaces or [])

    def compact(self, live: DataFrame, version: str) -> None:
        """One segment of the vectors in ``live`` (chunk_id) from all that count now."""
        kept = self.table("members").join(live.select("chunk_id").distinct(), "chunk_id", "left_semi")
        self.append(kept.select("owner_id", "chunk_id", F.col("unit").alias("embedding")), version, [v for v in self.versions() if v != version])
