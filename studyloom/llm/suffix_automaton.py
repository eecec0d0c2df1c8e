"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are dealt into blocks of bounded size; every block becomes one automaton, built in a Spark task.  Documents stream through the
automata in Arrow batches: words that cannot lie in a match are skipped by word and word-pair lookups, the rest are stepped through the
automaton, which tracks the longest match that ends at each word.  Automata are shipped in rounds of bounded size, so a benchmark of any
size passes; each round adds its spans and items to those found before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.common import LOWER, UPPER, cut, slices, text_bytes

WINDOW = 10
# Characters of items in one automaton, and bytes of automata that one round ships.
BLOCK_CHARS = 2_000_000
ROUND_BYTES = 64_000_000
# A document loses its hit spans; one of which more than this share of words is hit goes.
MAX_COVERAGE = 0.5

WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(ord(LOWER[UPPER.index(chr(c))]) if chr(c) in UPPER else c if c >= 0x80 or chr(c).isdigit() or chr(c) in LOWER else 0x20
              for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; every byte that is no word byte separates."""
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items whose windows each state stands for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        numbered = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, seq in numbered:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        # The state that stands for the last `window` words of a match, for every state that is long enough.
        self.tail = [-1] * len(self.size)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            if self.size[s] >= window:
                self.tail[s] = self.tail[self.link[s]] if self.size[self.link[s]] >= window else s
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, seq in numbered:
            s = 0
            for i, w in enumerate(seq):
                s = self.step[s][w]
                while self.size[self.link[s]] > i:  # keep the state whose strings include the prefix walked so far
                    s = self.link[s]
                if i + 1 >= window:
                    self.items.setdefault(self.tail[s], set()).add(name)
            if len(seq) < window:
                self.short.setdefault(s, []).append((len(seq), name))
        # The nearest state at or above each one, along suffix links, that stands for a whole short item.
        self.above = [-1] * len(self.size)
        for s in sorted(range(len(self.size)), key=self.size.__getitem__):
            self.above[s] = s if s in self.short else self.above[self.link[s]] if s else -1
        self.least = min([window, *(n for found in self.short.values() for n, _ in found)])
        pairs = {a * len(self.vocab) + b for _, seq in numbered for a, b in zip(seq, seq[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, w: int) -> int:
        if w in self.step[last]:
            q = self.step[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.step[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        while p != -1 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        return len(self.size) - 1

    def runs(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches [a, b) of known words joined by known pairs and as long as the shortest window: no match lies outside them."""
        known = numbers >= 0
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        if len(at):
            code = numbers[at].astype(np.int64) * len(self.vocab) + numbers[at + 1]
            spot = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[at] = self.pairs[spot] == code if len(self.pairs) else False
        starts = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        ends = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        long = ends - starts >= self.least
        return zip(starts[long].tolist(), ends[long].tolist())

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [a, b) in words, merged, and the items with an occurring window."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not words or not self.vocab:
            return spans, found
        get = self.vocab.get
        numbers = np.array([get(w, -1) for w in words], np.int64)
        step, link, size, window = self.step, self.link, self.size, self.window
        for a, b in self.runs(numbers):
            s = length = 0
            for i, w in enumerate(numbers[a:b].tolist(), a):
                while s and w not in step[s]:
                    s = link[s]
                    length = size[s]
                if w in step[s]:
                    s, length = step[s][w], length + 1
                if length >= window:
                    spans.append((i + 1 - length, i + 1))
                    found |= self.items[self.tail[s]]
                u = self.above[s]
                while u > 0:
                    for n, name in self.short[u]:
                        if n <= length:
                            spans.append((i + 1 - n, i + 1))
                            found.add(name)
                    u = self.above[link[u]]
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, bytes) of the pickled automata; items without words are in none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))

    def build(table: pa.Table) -> pa.Table:
        named = [("" if n is None else n, words_of(t)) for n, t in zip(table["item_id"].to_pylist(), table["text"].to_pylist())]
        blob = pickle.dumps(Automaton(named, window))
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "automaton": pa.array([blob], pa.binary())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(build, "block int, automaton binary")


FOUND = "doc_id {}, text string, n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, round_bytes: int = ROUND_BYTES,
          block_chars: int = BLOCK_CHARS, keep_text: bool = False) -> DataFrame:
    """(doc_id, text, n_words, spans, items) of every document: hit spans in words, and the sorted items with an occurring window.

    Null and wordless texts have no words and no hits; an empty benchmark hits nothing.  Items of fewer words than the window are one
    window.  Repeated items count once, by id.  ``text`` is null unless ``keep_text``.
    """
    return _match(docs, *_in_rounds(benchmark, window, round_bytes, block_chars), keep_text)


def _in_rounds(benchmark: DataFrame, window: int, round_bytes: int, block_chars: int) -> tuple[DataFrame, list[list[int]]]:
    """The automata, and their blocks by round."""
    blobs = cut(automata(benchmark, window, block_chars))
    rounds, room = [[]], round_bytes
    for block, n in blobs.select("block", F.length("automaton")).orderBy("block").toLocalIterator():
        if n > room and rounds[-1]:
            rounds.append([])
            room = round_bytes
        rounds[-1].append(block)
        room -= n
    return blobs, rounds


def _shipped(blobs: DataFrame, blocks: list[int]):
    found = blobs.where(F.col("block").isin(blocks)).collect() if blocks else []
    return blobs.sparkSession.sparkContext.broadcast([bytes(r["automaton"]) for r in found])


def _match(docs: DataFrame, blobs: DataFrame, rounds: list[list[int]], keep_text: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("spans"),
                      F.expr("cast(array() as array<string>)").alias("items"))
    for i, blocks in enumerate(rounds):
        out = out.mapInArrow(_matcher(_shipped(blobs, blocks), keep_text or i < len(rounds) - 1), FOUND.format(kind))
    return out


def _matcher(shipped, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [pickle.loads(x) for x in shipped.value]
        for b in batches:
            counts, spans, items = [], [], []
            for text, had, named in zip(text_bytes(b), b.column("spans").to_pylist(), b.column("items").to_pylist()):
                words = words_of(text)
                hit, found = [(x["a"], x["b"]) for x in had], set(named)
                for m in machines:
                    more, which = m.match(words)
                    hit += more
                    found |= which
                counts.append(len(words))
                spans.append([{"a": x, "b": y} for x, y in merged(hit)])
                items.append(sorted(found))
            texts = b.column("text") if keep_text else pa.nulls(len(b), pa.string())
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                                             ["doc_id", "text", "n_words", "spans", "items"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, min_span: int = 1,
          round_bytes: int = ROUND_BYTES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns kept, without hit spans of ``min_span`` words or more; a document hit on more than ``max_coverage``
    of its words goes.  Documents without hits are not touched; null texts stay.  The cut text is joined by a line break; ``n_chars`` follows.

    Automata of more than one round are passed in rounds: the spans of all rounds, then one cut, for documents that were cut again until none is.
    """
    blobs, rounds = _in_rounds(benchmark, window, round_bytes, block_chars)
    names, at = docs.columns, docs.columns.index("text")

    def columns_of(b: pa.RecordBatch, texts: list[bytes | None]) -> list[pa.Array]:
        """The columns of ``docs`` with other texts."""
        columns = [b.column(i) for i in range(len(names))]
        cast = [None if t is None else t.decode() for t in texts]
        columns[at] = pa.array(cast, b.schema.field(at).type)
        if "n_chars" in names:
            n = names.index("n_chars")
            changed = pa.array([old if x is None or t == x else len(t or "") for old, x, t in zip(columns[n].to_pylist(), b.column(at).to_pylist(), cast)])
            columns[n] = changed.cast(b.schema.field(n).type)
        return columns

    def long_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [(x, y) for x, y in merged(spans) if y - x >= min_span]

    def too_much(spans: list[tuple[int, int]], total: int) -> bool:
        return sum(y - x for x, y in spans) > max_coverage * total

    def in_one_round(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = [pickle.loads(x) for x in shipped.value]
            for b in slices(batches):
                keep, texts = [], []
                for text in text_bytes(b):
                    kept = text
                    while True:  # what is left may meet across a cut
                        words = words_of(kept)
                        spans = long_spans([s for m in machines for s in m.match(words)[0]])
                        if not spans:
                            break
                        if kept is text and too_much(spans, len(words)):
                            kept = None
                            break
                        kept = without(kept, spans)
                    keep.append(text is None or kept is not None)
                    texts.append(kept)
                yield pa.RecordBatch.from_arrays(columns_of(b, texts), names).filter(pa.array(keep))

        return run

    def one_cut(first: bool):
        """Rows with their spans and words behind them become rows cut once, with a mark on those that were cut."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep, texts, marks = [], [], []
                for text, had, total in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()):
                    spans = long_spans([(x["a"], x["b"]) for x in had])
                    keep.append(not (first and spans and too_much(spans, total)))
                    texts.append(without(text, spans) if spans and keep[-1] else text)
                    marks.append(bool(spans))
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns_of(b, texts), names), pa.array(marks)], ["row", "again"]).filter(pa.array(keep))

        return run

    if len(rounds) == 1:
        return docs.mapInArrow(in_one_round(_shipped(blobs, rounds[0])), docs.schema)
    first, done = True, []
    left = docs.select(F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in names]).alias("row"))
    while True:
        met = _match(left.select(F.col("row").alias("doc_id"), F.col("row").getField("text").alias("text")), blobs, rounds, False)
        flat = met.select(*[F.col("doc_id").getField(c).alias(c) for c in names], F.col("spans").alias("_spans"), F.col("n_words").alias("_words"))
        once = cut(flat.mapInArrow(one_cut(first), T.StructType([T.StructField("row", docs.schema), T.StructField("again", T.BooleanType())])))
        done.append(once.where("not again"))
        left, first = once.where("again").select("row"), False
        if not left.limit(1).count():
            break
    rows = reduce(DataFrame.unionAll, done)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names])


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what lies between them."""
    places = [m.span() for m in WORD_BYTES.finditer(text.translate(_FOLD))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:places[a][0]])
        last = places[b - 1][1]
    return b"\n".join([*out, text[last:]])
