"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash blocks and min-hash bands find candidates, shingle sets verify them.

A document is the set of its hashed shingles; equal sets are one entry.  The SimHash of a set is linked to those within ``DISTANCE`` bits by
``simhash.link_fingerprints``, which loses none; but sets of similarity 0.8 differ in 8 bits on average, so an entry is also posted under ``BANDS`` keys of ``ROWS`` min-hashes
each, which meet in at least one key with probability 1 - (1 - J ** ROWS) ** BANDS: 0.9993 at 0.8, 0.99999 at 0.85.  Entries that share
a key or have linked fingerprints form loose regions.  Only the sets of regions of two or more travel; a region is cut into parts, every two parts are one group of
bounded size, and a group gives a spanning star of the links that hold exactly, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import xxhash

from studyloom.llm.common import cut, let_go, slices, text_bytes
from studyloom.llm.graph import components
from studyloom.llm.simhash import SEED, _union, link_fingerprints, named, set_print, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 8
# Entries, and shingles of entries, in a part of a region.
PART, PART_SHINGLES = 256, 500_000
# Shingles that are hashed or multiplied at once.
SLICE, COLUMNS = 2048, 4096

_TURNS = np.random.default_rng(SEED).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; none of a text without words."""
    found = [np.unique(h) for h in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, "<u8")


def entry_of(found: np.ndarray) -> int:
    """Signed 64-bit name of a set; zero for the empty one."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], "u8").view("i8")[0]) if len(found) else 0


def band_keys(found: np.ndarray) -> np.ndarray:
    """One signed key a band."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), SLICE):
        np.minimum(least, (short[at:at + SLICE, None] * _TURNS).min(0), out=least)
    rows = np.ascontiguousarray(least.reshape(BANDS, ROWS))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], "u8").view("i8")


def _described(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, shingle) for t in text_bytes(b)]
            keys = [band_keys(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([entry_of(s) for s in sets], pa.int64()), pa.array([set_print([s]) for s in sets], pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fingerprint", "simhash", "keys"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, shingle) for t in text_bytes(b)]
            yield pa.RecordBatch.from_arrays([pa.array([entry_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             ["fingerprint", "shingles"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, column, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    wide = np.flatnonzero(met > 1)
    number = np.full(len(met), -1)
    number[wide] = np.arange(len(wide))
    column = number[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers up to 2 ** 24
    for at in range(0, len(wide), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        table = np.zeros((len(sets), min(COLUMNS, len(wide) - at)), np.float32)
        table[row[a:b], column[a:b] - at] = 1
        out += table @ table.T
    return out.astype(np.int64)


def _verify(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        value = table["fingerprint"].to_numpy()
        order = np.argsort(value)
        value = value[order]
        blobs = table["shingles"].to_pylist()
        sets = [np.frombuffer(blobs[i], "<u8") for i in order.tolist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        both = shared_counts(sets)
        close = np.triu(both >= similarity * (size[:, None] + size - both), 1)
        root = np.arange(len(sets))
        _union(root, zip(*(x.tolist() for x in np.nonzero(close))))
        while not np.array_equal(root, up := root[root]):
            root = up
        moved = np.flatnonzero(root != np.arange(len(root)))
        del blobs, sets, both, close
        let_go()
        return pa.table({"u": pa.array(value[moved], pa.int64()), "v": pa.array(value[root[moved]], pa.int64())})

    return run


def simhash_links(prints: DataFrame) -> DataFrame:
    """(u, v) of entries (fingerprint, simhash) whose SimHashes are equal or linked within a few bits; spanning links, never pairs."""
    held = prints.groupBy("simhash").agg(F.min("fingerprint").alias("least"))
    equal = prints.join(held, "simhash").where("fingerprint <> least").select(F.col("fingerprint").alias("u"), F.col("least").alias("v"))
    near = link_fingerprints(held.select(F.col("simhash").alias("fingerprint")))
    named_u = near.join(held.select(F.col("simhash").alias("u"), F.col("least").alias("one")), "u")
    ends = named_u.join(held.select(F.col("simhash").alias("v"), F.col("least").alias("two")), "v")
    return equal.union(ends.select("one", "two"))


def band_links(prints: DataFrame) -> DataFrame:
    """(u, v) of entries (fingerprint, keys) that share a key, as stars around the least entry of each key; never pairs."""
    posted = prints.select("fingerprint", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("fingerprint").alias("least")).where("n > 1")
    met = posted.join(shared.hint("merge"), "key").where("fingerprint <> least")  # exploded rows are sized too low to be shipped on an estimate
    return met.select(F.col("fingerprint").alias("u"), F.col("least").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every row, as ``simhash.near_duplicates`` gives it, for links of ``similarity`` or more.

    Texts without words are one entry; a text of fewer words than a shingle is one shingle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(docs.select("doc_id", "text").mapInArrow(_described(shingle), f"doc_id {kind}, fingerprint long, simhash long, keys array<long>"))
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.first("simhash").alias("simhash"), F.first("keys").alias("keys"))
    loose = cut(components(band_links(prints).union(simhash_links(prints.where("keys is not null"))))).select(F.col("node").alias("fingerprint"), F.col("component").alias("region"))
    sets = (docs.select("text").mapInArrow(_sets(shingle), "fingerprint long, shingles binary")
            .groupBy("fingerprint").agg(F.first("shingles").alias("shingles")).join(loose, "fingerprint"))  # copies are one before they are dealt
    sets = cut(sets)
    room = F.greatest(F.count("*") / part, F.sum(F.length("shingles")) / (8 * PART_SHINGLES))
    parts = sets.groupBy("region").agg(F.ceil(room).cast("int").alias("parts"))
    dealt = sets.join(parts, "region").withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    # A part meets itself in the groups with every other part; alone it is a group only where it is the region.
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own")))
    met = (dealt.select("region", "fingerprint", "shingles", "own", F.explode(other).alias("other"))
           .select("region", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "fingerprint", "shingles"))
    links = met.groupBy("region", "one", "two").applyInArrow(_verify(similarity), "u long, v long").distinct()
    return named(rows.select("doc_id", "fingerprint"), prints.select("fingerprint", "first"), components(links))
