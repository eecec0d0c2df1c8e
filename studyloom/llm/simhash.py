"""SimHash near-duplicates: pigeonhole blocks find close fingerprints, Hamming distance verifies them.

Fingerprints are made once per document in Arrow batches.  Only distinct fingerprints are compared.  With B blocks and D differing bits
allowed, two close fingerprints agree on at least B - D blocks, so each is posted under every choice of B - D blocks (35 keys of 27 or
28 bits for 7 and 4).  Keys of one fingerprint are dropped.  A key of many is cut into parts and every pair of parts is a group of its
own; a group yields a spanning star of its close members, never its pairs.  Stars are joined by ``graph.components``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import xxhash

from studyloom.llm.common import ASCII_LOWER, cut, text_bytes
from studyloom.llm.graph import components

SHINGLE = 4
DISTANCE = 4
BLOCKS = 7
SEED = 42
# Fingerprints of one key that are compared in one group; larger keys are cut into parts of about this size.
PART = 1024
# Shingles whose bits are counted at once.
SLICE = 1 << 16


def shingle_hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in slices; none of a text without words."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(words) > shingle:
        start, end = start[: 1 - shingle], end[shingle - 1:]
    else:
        start, end = start[:1], end[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), SLICE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(start[at:at + SLICE].tolist(), end[at:at + SLICE].tolist())], "<u8")


def set_print(slices: Iterable[np.ndarray]) -> int:
    """SimHash of hashes as a signed 64-bit number; a bit is set if it is set in over half of them."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in slices:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's shingles."""
    return set_print(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long) for every row; null and blank texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(t, shingle) for t in text_bytes(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), prints], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


def block_keys(fp: F.Column, blocks: int, distance: int) -> F.Column:
    """One key for every choice of blocks - distance blocks: the number of the choice, then the bits of its blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def _union(root: np.ndarray, pairs: Iterator[tuple[int, int]]) -> None:
    for a, b in pairs:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)


def close_stars(group: np.ndarray, value: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member, smallest member's value) of values within ``distance`` bits in the same group; groups are contiguous."""
    root = np.arange(len(group))
    at, step = np.arange(len(group)), 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        near = at[np.bitwise_count((value[at] ^ value[at + step]).view("u8")) <= distance]  # of signed numbers it counts the magnitude
        near = near[root[near] != root[near + step]]
        if len(near):
            _union(root, zip(near.tolist(), (near + step).tolist()))
            while not np.array_equal(root, up := root[root]):
                root = up
        step += 1
    moved = np.flatnonzero(root != np.arange(len(root)))
    return value[moved], value[root[moved]]


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_value = np.zeros(0, "i8"), np.zeros(0, "i8")

        def emit(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            u, v = close_stars(key, value, distance)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            key = np.concatenate([kept_key, b.column("group").to_numpy()])
            value = np.concatenate([kept_value, b.column("fingerprint").to_numpy()])
            if not len(key):
                continue
            cutoff = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            kept_key, kept_value = key[cutoff:], value[cutoff:]
            if cutoff:
                yield emit(key[:cutoff], value[:cutoff])
        if len(kept_key):
            yield emit(kept_key, kept_value)

    return run


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """Spanning links (u, v) of distinct fingerprints within ``distance`` bits."""
    posted = prints.select("fingerprint", F.explode(block_keys(F.col("fingerprint"), blocks, distance)).alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), parts).cast("int")
    # Spark sizes exploded rows as if there was one a fingerprint, so either side could be taken for a table small enough to ship.
    met = (posted.join(shared.hint("merge"), "key").select("key", "fingerprint", parts.alias("parts"), own.alias("own"))
           .select("key", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
           .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "fingerprint"))
    grouped = met.repartition("group").sortWithinPartitions("group", "fingerprint")
    return grouped.mapInArrow(_verify(distance), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS,
                    part: int = PART) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every row; the component is the smallest id reachable by links.

    Null and blank texts have fingerprint zero and link like any other.  Repeated rows and ids share a fingerprint or differ by their own
    text; a null id never becomes a component unless all ids of the component are null.  Extra columns are not read.
    """
    rows = cut(fingerprints(docs, shingle))
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    return named(rows, prints, components(link_fingerprints(prints, distance, blocks, part)))


def named(rows: DataFrame, prints: DataFrame, linked: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fingerprint) with the smallest id of their component; ``prints`` has the smallest id of each fingerprint."""
    rooted = (prints.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
              .select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    names = rooted.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id")
    return rows.join(names, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _column(docs: DataFrame, name: str) -> F.Column:
    return docs["`" + name.replace("`", "``") + "`"]


def keep_one(docs: DataFrame, find: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """The rows of ``docs`` with one row of each component that ``find`` gives, that of the smallest id; all columns stay.

    Rows are told apart by id and a hash of the whole row, so null and repeated ids never stand for each other.  A null id comes last.
    Of rows equal in every column, which are copies of each other, one stays.
    """
    columns = [_column(docs, c) for c in docs.columns]
    mark = "_row"
    while mark in docs.columns:  # the rows may have a column of any name
        mark += "_"
    whole = F.xxhash64(*columns, *[c.isNull() for c in columns])  # nulls leave a hash as it is
    keyed = docs.select(F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), whole.alias("row")).alias("doc_id"), docs["text"])
    found = find(keyed, **options)
    kept = cut(found.where("doc_id = component_id").groupBy(F.col("doc_id.id").alias(f"{mark}id"), F.col("doc_id.row").alias(f"{mark}kept")).agg(F.count("*").alias(f"{mark}n")))
    marked = docs.select("*", whole.alias(mark))
    chosen = kept.select(f"{mark}id", f"{mark}kept")
    one = marked.join(chosen, (F.col(mark) == F.col(f"{mark}kept")) & F.col("doc_id").eqNullSafe(F.col(f"{mark}id")), "left_semi")
    return (one.dropDuplicates(["doc_id", mark]) if kept.where(F.col(f"{mark}n") > 1).limit(1).count() else one).drop(mark)
