"""Stored search index of chunks: word postings with positions, character trigrams and texts.

Tables are kept in segments (``sources.segments``), cut into buckets by what they are looked up by: owner and term, owner and trigram, chunk.
A question reads the folders of its buckets and no others.

Which chunks count is decided when a question is asked (``is_active``, READY documents): a superseded chunk set leaves the index the moment
its rows say so, and ``compact`` drops its postings from storage later.
"""

from __future__ import annotations

from collections.abc import Iterator
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from studyloom.functions.text import words
from studyloom.sources.segments import Segments

# Chunk ids that share a part: a trigram's list is kept in parts, so no list grows with an owner.
PART = 4096
# Characters in a gram, and the bits of one: code points have 21.
GRAM, BITS = 3, 21
# Characters of text, and words of it, that a worker indexes at once, whatever the size of an Arrow batch.
CHARACTERS, WORDS = 1 << 22, 1 << 19


def tokens(text: Column) -> Column:
    """Words of a text as searches compare them."""
    return words(F.lower(F.coalesce(text, F.lit(""))))


def gram_codes(text: str) -> np.ndarray:
    """Distinct trigrams of a text, sorted, three code points in one number each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < GRAM:
        return np.zeros(0, np.int64)
    return np.unique(points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal keys."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(change)


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, number) whose sizes add up to ``limit`` at most; a larger row is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, end - at
        at = end


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chunk and term, from rows (owner_id, chunk_id, tokens)."""
    for b in (whole.slice(*run) for whole in batches for run in _slices(pc.list_value_length(whole.column("tokens")).to_numpy(), WORDS)):
        listed = b.column("tokens")
        flat = pc.list_flatten(listed)
        if not len(flat):
            continue
        row = pc.list_parent_indices(listed).to_numpy()
        size = pc.list_value_length(listed).to_numpy()
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        words_ = flat.dictionary_encode()
        term = words_.indices.to_numpy()
        order = np.lexsort((place, term, row))
        row, term, place = row[order], term[order], place[order]
        first = _runs(row, term)
        ends = np.append(first, len(row)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("owner_id").take(pa.array(row[first])), words_.dictionary.take(pa.array(term[first])), b.column("chunk_id").take(pa.array(row[first])),
                                          pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))],
                                         ["owner_id", "term", "chunk_id", "tf", "positions"])


def _gram_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunk ids by owner, trigram and part, from rows (owner_id, chunk_id, low); a list may come in several rows."""
    for b in (whole.slice(*run) for whole in batches for run in _slices(pc.utf8_length(whole.column("low")).to_numpy(), CHARACTERS)):
        codes = [gram_codes(t.as_py()) for t in b.column("low")]
        size = [len(c) for c in codes]
        if not sum(size):
            continue
        gram = np.concatenate(codes)
        owner, chunk = (np.repeat(b.column(c).to_numpy(), size) for c in ("owner_id", "chunk_id"))
        order = np.lexsort((chunk, gram, owner))
        owner, gram, chunk = owner[order], gram[order], chunk[order]
        part = chunk // PART
        first = _runs(owner, gram, part)
        ends = pa.array(np.append(first, len(gram)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(gram[first]), pa.array(part[first]), pa.ListArray.from_arrays(ends, pa.array(chunk))],
                                         ["owner_id", "gram", "part", "ids"])


class SearchIndex(Segments):
    """The index under ``root``."""

    TABLES = {
        "postings": "owner_id long, term string, chunk_id long, tf int, positions array<int>, bucket int",
        "terms": "owner_id long, term string, chunks long, bucket int",
        "grams": "owner_id long, gram long, part long, ids array<long>, bucket int",
        "gram_sizes": "owner_id long, gram long, chunks long, bucket int",
        "texts": "chunk_id long, content string, bucket int",
    }

    # ------------------------------------------------------------------------------ writing
    def append(self, chunks: DataFrame, version: str, kinds: tuple[str, ...] = ("words", "grams")) -> None:
        """Index ``chunks`` (owner_id, chunk_id, content) as one segment.  The same version again replaces what it wrote before.

        Null texts have no words; a chunk belongs to one version.  ``kinds`` says what the index is for, the same in every append.
        """
        rows = chunks.select(F.col("owner_id").cast("long").alias("owner_id"), F.col("chunk_id").cast("long").alias("chunk_id"), "content").where("owner_id is not null and chunk_id is not null")
        segment = f"segment-{uuid.uuid4().hex}"
        if "words" in kinds:
            postings = rows.select("owner_id", "chunk_id", tokens(F.col("content")).alias("tokens")).mapInArrow(_postings, "owner_id long, term string, chunk_id long, tf int, positions array<int>")
            self._write(segment, "postings", postings, ["owner_id", "term"], ["chunk_id"])
        if "grams" in kinds:
            low = rows.select("owner_id", "chunk_id", F.lower(F.coalesce("content", F.lit(""))).alias("low"))
            self._write(segment, "grams", low.mapInArrow(_gram_lists, "owner_id long, gram long, part long, ids array<long>"), ["owner_id", "gram"], ["part"])
        self._write(segment, "texts", rows.select("chunk_id", "content"), ["chunk_id"], [])
        self._count(segment, kinds)
        self._note(version, segment, [])

    def _count(self, segment: str, kinds: tuple[str, ...]) -> None:
        """Numbers of chunks by term and by trigram, from the written lists."""
        if "words" in kinds:
            terms = self._of(segment, "postings").groupBy("owner_id", "term").agg(F.count(F.lit(1)).alias("chunks"))
            self._write(segment, "terms", terms, ["owner_id", "term"], [])
        if "grams" in kinds:
            sizes = self._of(segment, "grams").groupBy("owner_id", "gram").agg(F.sum(F.size("ids")).alias("chunks"))
            self._write(segment, "gram_sizes", sizes, ["owner_id", "gram"], [])

    def compact(self, live: DataFrame, version: str, kinds: tuple[str, ...] = ("words", "grams")) -> None:
        """One segment of the chunks in ``live`` (chunk_id) from all that count now; the old ones stop counting with the new one's note."""
        old, segment = self.versions(), f"segment-{uuid.uuid4().hex}"
        alive = live.select("chunk_id").distinct()
        if "words" in kinds:
            self._write(segment, "postings", self.table("postings").drop("bucket").join(alive, "chunk_id", "left_semi"), ["owner_id", "term"], ["chunk_id"])
        if "grams" in kinds:
            ids = self.table("grams").select("owner_id", "gram", "part", F.explode("ids").alias("chunk_id")).join(alive, "chunk_id", "left_semi")
            lists = ids.groupBy("owner_id", "gram", "part").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))
            self._write(segment, "grams", lists, ["owner_id", "gram"], ["part"])
        self._write(segment, "texts", self.table("texts").drop("bucket").join(alive, "chunk_id", "left_semi"), ["chunk_id"], [])
        self._count(segment, kinds)
        self._note(version, segment, [v for v in old if v != version])

    # ------------------------------------------------------------------------------ reading
    def counts(self, name: str, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, chunks) over all segments, superseded chunks included: good enough to tell rare from frequent."""
        return self.lookup(name, wanted, keys, ["chunks"]).groupBy(*keys).agg(F.sum("chunks").alias("chunks"))
