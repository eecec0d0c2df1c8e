"""BPE encoding and decoding with a distinct-word table.

A word is a stretch between ASCII white space; the tokenizer's own rules never join two of them, so a text's ids are those of its words
in order.  Documents are dealt into units of bounded size, whose texts travel once, in compressed blocks.  Each unit posts its distinct
words, sorted, in one block for each shard of the word table; a shard meets the blocks of all units, encodes each distinct word once, and
sends the ids back by position to the units that posted them.  No word is gathered with its documents: a unit posts it once, however often
it occurs there, and a shard reads one block at a time.  Decoding joins each id with its piece by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import let_go, shape, text_bytes

# Bytes of text in a unit, about.
UNIT_BYTES = 16_000_000
# Shards of the word table, at most; fewer where there are fewer units.
SHARDS = 4096
# Encoded words that a shard remembers; beyond, it forgets them all and meets them anew.
REMEMBERED = 500_000
# Tokens that are decoded at once.
SLICE = 1 << 18


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The public tokenizer of a file, once a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """Piece of every id; an id without a piece gives none."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    vocab = stored["model"]["vocab"] | {t["content"]: t["id"] for t in stored["added_tokens"]}
    table: list[str | None] = [None] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        table[i] = piece
    return pa.array(table, pa.string())


def encode_words(path: str, words: list[bytes]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]


def packed(rows: pa.RecordBatch, level: int = 1) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def packed_list(values: list[bytes]) -> bytes:
    return packed(pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"]))


def unpacked(block) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(block.as_buffer())


def unpacked_list(block) -> list[bytes]:
    return [v for rows in unpacked(block) for v in rows.column("value").to_pylist()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch as one compressed block for each unit."""
    for b in batches:
        unit = b.column("unit").to_numpy()
        order = np.argsort(unit, kind="stable")
        names, first = np.unique(unit[order], return_index=True)
        for name, at in zip(names.tolist(), np.split(order, first[1:])):
            block = packed(b.select(["doc_id", "text"]).take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([block], pa.binary())], ["unit", "block"])


def _dealt(blocks: pa.ChunkedArray, shards: int) -> list[list[bytes]]:
    """Distinct words of a unit, sorted, by shard."""
    found: set[bytes] = set()
    for block in blocks:
        for rows in unpacked(block):
            for text in text_bytes(rows):
                found.update((text or b"").split())
    out: list[list[bytes]] = [[] for _ in range(shards)]
    for word in found:
        out[zlib.crc32(word) % shards].append(word)
    for words in out:
        words.sort()
    return out


def _post(shards: int):
    def run(table: pa.Table) -> pa.Table:
        posted = [(shard, packed_list(words)) for shard, words in enumerate(_dealt(table["block"], shards)) if words]
        unit = table["unit"][0].as_py()
        return pa.table({"unit": pa.array([unit] * len(posted), pa.int32()), "shard": pa.array([x for x, _ in posted], pa.int32()), "words": pa.array([x for _, x in posted], pa.binary())})

    return run


def _encode(path: str):
    """Ids of posted words, block by block; the blocks of a shard come one after the other, so a word met before is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        last = None
        for b in batches:
            for unit, shard, block in zip(b.column("unit").to_pylist(), b.column("shard").to_pylist(), b.column("words")):
                words = unpacked_list(block)
                if shard != last or len(known) > REMEMBERED:
                    known.clear()
                last = shard
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, (np.array(x, "<u4").tobytes() for x in encode_words(path, fresh))))
                ids = packed_list([known[w] for w in words])
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([shard], pa.int32()), pa.array([ids], pa.binary())], ["unit", "shard", "ids"])
        known.clear()
        tokenizer.cache_clear()  # a worker that goes on to other work keeps neither words nor tokenizer
        let_go()

    return run


def _assemble(shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table: dict[bytes, bytes] = {}
        back = dict(zip(right["shard"].to_pylist(), right["ids"]))
        for shard, words in enumerate(_dealt(left["block"], shards)):
            if words:
                table.update(zip(words, unpacked_list(back[shard]), strict=True))
        get = table.__getitem__
        doc_ids, encoded = [], []
        for block in left["block"]:
            for rows in unpacked(block):
                doc_ids.append(rows.column("doc_id"))
                encoded.append(pa.array([b"".join(map(get, (text or b"").split())) for text in text_bytes(rows)], pa.binary()))
        table.clear()
        let_go()
        return pa.table({"doc_id": pa.chunked_array(doc_ids), "ids": pa.chunked_array(encoded)})

    return run


def encode(docs: DataFrame, path: str, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(doc_id, ids) of every row: ids as little-endian unsigned 32-bit numbers in one binary, as the tokenizers library gives them without
    added special tokens; special strings inside texts are found as it finds them.  Null and blank texts give an empty binary.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, -(-int(size) // unit_bytes))
    shards = min(units, SHARDS)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(units)).cast("int").alias("unit"), "doc_id", "text")
    blocks = dealt.mapInArrow(_blocks, "unit int, block binary").repartition("unit")
    posted = blocks.groupBy("unit").applyInArrow(_post(shards), "unit int, shard int, words binary")
    known = posted.repartition("shard").sortWithinPartitions("shard").mapInArrow(_encode(path), "unit int, shard int, ids binary")
    return blocks.groupBy("unit").cogroup(known.groupBy("unit")).applyInArrow(_assemble(shards), shape(docs, ids="binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids): the pieces of the ids with a blank between them, as a tokenizer without decoder puts it;
    null or empty ids give an empty text, numbers without a piece are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("ids")), 0).to_numpy(zero_copy_only=False) // 4
            ends = np.cumsum(sizes)
            a = 0
            while a < len(b):
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
                ids = pc.fill_null(b.column("ids").slice(a, z - a), b"")
                numbers = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
                met = table.take(pa.array(numbers, mask=numbers >= len(table)))
                bounds = pa.array(np.concatenate([[0], ends[a:z] - (ends[a - 1] if a else 0)]), pa.int32())
                if met.null_count:
                    there = met.is_valid().to_numpy(zero_copy_only=False)
                    bounds = pa.array(np.concatenate([[0], np.cumsum(there)])[bounds.to_numpy()], pa.int32())
                    met = met.drop_null()
                text = pc.binary_join(pa.ListArray.from_arrays(bounds, met), " ")
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), ids, text], ["doc_id", "ids", "text"])
                a = z
        del table
        pieces.cache_clear()
        let_go()

    return encoded.select("doc_id", "ids").mapInArrow(run, shape(encoded, ids="binary", text="string"))
