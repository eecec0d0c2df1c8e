"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
import ctypes
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.session import checkpoint_dir, cut, swept

# A-Z and a-z, the only letters that the contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding to Python strings."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def let_go() -> None:
    """Give memory that a worker no longer needs back to the machine; workers are kept for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library can
        pass


# Bytes of text that a task turns into sets or matches at once, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 22


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most ``size`` bytes of text, or of one row; memory goes back when the task has read its last one."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
            yield b.slice(a, z - a)
            a = z
        del b, ends
        let_go()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back: a lost executor costs a read, not the work."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: F.Column | str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


# Bits of a filter of ids at most: 8 MB, whatever the number of ids.
FILTER_BITS = 1 << 26


def among(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose id is in ``ids``: a left semi join whose larger side is thinned first by three bits for each id.

    The filter is bounded whatever the number of ids; with very many it only lets more rows through to the join.
    """
    bits = min(FILTER_BITS, max(64, 16 * ids.count()))
    spots = lambda c: F.array(*[F.pmod(F.xxhash64(c, F.lit(i)), F.lit(bits)) for i in range(3)])
    spot = ids.where(F.col(key).isNotNull()).select(F.explode(spots(key)).alias("spot"))
    words = spot.select((F.col("spot") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("spot") % 64).cast("int")).alias("bit"))
    set_ = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(-(-bits // 64), np.int64)
    table[set_["word"].to_numpy()] = set_["bits"].to_numpy()
    shipped = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_be(places: pd.Series) -> pd.Series:
        at = np.array(places.tolist(), np.int64).reshape(-1, 3)
        return pd.Series((shipped.value[at >> 6] >> (at & 63) & 1).all(axis=1))

    # The ids grow with the rows, so they are never shipped themselves, not even where they would fit today.
    return rows.where(F.col(key).isNotNull()).where(may_be(spots(key))).join(ids.select(key).distinct().hint("merge"), key, "left_semi")


def shape(docs: DataFrame, *kept: str, **added: str) -> T.StructType:
    """Schema of doc_id and other columns kept from ``docs``, whatever their types, followed by added ones."""
    fields = [T.StructField(c, docs.schema[c].dataType) for c in ("doc_id", *kept)]
    return T.StructType([*fields, *[T.StructField(c, T.DataType.fromDDL(kind)) for c, kind in added.items()]])


__all__ = ["ASCII_LOWER", "LOWER", "UPPER", "among", "cut", "fold_of", "let_go", "shape", "slices", "stored", "text_bytes"]
