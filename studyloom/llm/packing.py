"""Best-fit packing by sums of squares: documents of tokens into as few sequences of a fixed length as they go.

Documents are encoded where they are read and leave as pieces: number, start, length and checksum, never ids.  Pieces are dealt to shards of
bounded size.  A shard keeps the number of open sequences per residual gap and puts each piece, longest first, where the sum of the squares
of these numbers becomes smallest: into a sequence of some gap, or into a new one.  The pieces of sequences that stay open with room to
spare are then packed again, from all shards together, so that shards cost no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.common import stored, text_bytes
from studyloom.llm.merges import merger

LIMIT = 2048
# Bytes of text that are split at once.
SLICE = 1 << 22
# Pieces in a shard, about.
SHARD = 1 << 16
# A sequence is packed again if it lacks at least this many of its tokens, one part in so many; and how often that is done at most.
SPARE, AGAIN = 64, 3
BLANK = b" \t\n\r\x0b\x0c"


def slices(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (text number, part) of about SLICE bytes; long texts are cut at white space only."""
    group, room = [], SLICE
    for i, text in enumerate(texts):
        a = 0
        while a < len(text):
            z = min(len(text), a + room)
            if z < len(text):
                z = max(text.rfind(bytes([c]), a, z) for c in BLANK) + 1 or _next_blank(text, z)
            group.append((i, text[a:z]))
            room -= z - a
            a = z
            if room <= 0 or a < len(text):
                yield group
                group, room = [], SLICE
    if group:
        yield group


def _next_blank(text: bytes, a: int) -> int:
    found = [p for p in (text.find(bytes([c]), a) for c in BLANK) if p >= 0]
    return min(found) + 1 if found else len(text)


def encode_texts(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of every text, as little-endian unsigned 32-bit numbers."""
    table = merger(path)
    out: list[list[bytes]] = [[] for _ in texts]
    for group in slices(texts):
        for (i, _), ids in zip(group, table.encode([part for _, part in group])):
            out[i].append(ids)
    return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, its ids followed by id 0; only documents over ``limit`` ids are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, number, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode_texts([t or b"" for t in text_bytes(b)], path)):
                ids += bytes(4)
                for k, a in enumerate(range(0, len(ids), 4 * limit)):
                    own = ids[a:a + 4 * limit]
                    row.append(i)
                    number.append(k)
                    start.append(a // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            columns = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def place(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of every length, and what each sequence lacks.

    With N(g) open sequences of gap g, a piece of length s moves one of them from g to g - s and changes the sum of squares by
    2 (N(g - s) - N(g) + 1); filling it up changes it by 1 - 2 N(s), a new sequence by 2 N(limit - s) + 1.  Ties go to the smallest gap, then to
    a new sequence.
    """
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_ = np.zeros(limit + 1, np.int64)
    held: list[list[int]] = [[] for _ in range(limit + 1)]
    sequences = 0
    worst = np.iinfo(np.int64).max // 4
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gap, least = limit, 2 * open_[limit - s] + 1 if s < limit else 0
        if s < limit:
            here = open_[s:limit]
            change = np.where(here > 0, 2 * (open_[:limit - s] - here + 1), worst)
            if here[0]:
                change[0] = 1 - 2 * here[0]
            at = int(change.argmin())
            if change[at] <= least:
                gap = s + at
        if gap == limit:
            number[i] = sequences
            sequences += 1
        else:
            number[i] = held[gap].pop()
            open_[gap] -= 1
        offset[i] = limit - gap
        if gap > s:
            held[gap - s].append(int(number[i]))
            open_[gap - s] += 1
    lacks = np.zeros(sequences, np.int64)
    for gap, those in enumerate(held):
        lacks[those] = gap
    return number, offset, lacks


def packed(rows: DataFrame, shards: int, turn: int, limit: int = LIMIT) -> DataFrame:
    """``rows`` with sequence_id, offset and ``lacks``, what their sequence is short of; each shard is packed for itself."""
    fields = [*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "lacks")]]
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(shards)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sequence, offset, lacks = place(table["length"].to_numpy(), limit)
        shown = (turn << 56) + (key[0].as_py() << 24) + sequence
        table = table.drop_columns(["_shard"])
        for name, values in (("sequence_id", shown), ("offset", offset), ("lacks", lacks[sequence])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return dealt.groupBy("_shard").applyInArrow(run, T.StructType(fields))


def pack(docs: DataFrame, path: str, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of ``docs``.

    A null or empty text is the single id 0.  Rows with equal, repeated or null ids are documents of their own; very long texts are encoded
    in slices and give as many pieces as they need; ties go by the order in which a shard meets its pieces; an empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    rows = stored(pieces(docs, path, limit))
    names, done = rows.columns, []
    for turn in range(AGAIN + 1):
        count = rows.count()
        shards = max(1, -(-count // shard))
        found = stored(packed(rows, shards, turn, limit))
        spare = found.where(F.col("lacks") >= max(1, limit // SPARE)).select(names)
        # Packing again pays where few pieces are left of many shards; pieces that fill nothing anywhere are left as they are.
        if turn == AGAIN or shards == 1 or spare.count() > count / 2:
            done.append(found)
            break
        done.append(found.where(F.col("lacks") < max(1, limit // SPARE)))
        rows = spare
    total = done[0]
    for more in done[1:]:
        total = total.unionByName(more)
    return total.select(*names, "sequence_id", "offset")
