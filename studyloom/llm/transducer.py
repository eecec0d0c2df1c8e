"""Token counts by a compiled finite-state transducer.

Compilation: the words (stretches between ASCII white space) that recur in a bounded sample of the corpus are counted once each by the
tokenizer and become a deterministic automaton over ASCII-folded bytes.  Its transitions inside words emit nothing; the white-space
transition out of a word's state emits that word's tokens and returns to the start.  White space resets the automaton, and no word of it
is longer than a chunk, so the state map of a chunk is constant: its exit state does not depend on the state it is entered in.

Running: a batch of texts is one byte string, cut into chunks that all step at once.  The first pass runs every chunk from the dead
state and gives its exit state; composing the maps along the chunks, a prefix scan of constants, gives every entry state; the second pass
runs the head of every chunk, up to its first white space, from there.  A scan over the emitted counts gives the sum of every text.
Words that leave the automaton are counted by the tokenizer itself, each distinct one once a slice, so counts are exact on any text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import ASCII_LOWER, cut, text_bytes
from studyloom.llm.word_bpe import encode_words

# Bytes of text that the compiler reads, about; words that occur this often there are compiled, if they are no longer than LONGEST.
SAMPLE_BYTES = 40_000_000
LEAST_COUNT = 3
LONGEST = 40
CHUNK = 512
# Bytes of text that are stepped through at once.
SLICE = 1 << 23
LIMIT = 2048
# The white space of ASCII.
SPACE = b" \t\n\r\x0b\x0c"
ROOT, DEAD = 0, 1


@dataclass
class Transducer:
    """States with a bit mask of the byte classes they continue with; the children of a state have consecutive numbers in class order."""

    classes: np.ndarray  # byte -> class; 0 is white space, 63 what no compiled word holds
    mask: np.ndarray  # [states] uint64
    base: np.ndarray  # [states] first child
    emit: np.ndarray  # [states] tokens of the word that ends here, -1 if none does

    def step(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        bit = np.uint64(1) << cls.astype(np.uint64)
        held = self.mask[state]
        return np.where(held & bit != 0, self.base[state] + np.bitwise_count(held & (bit - np.uint64(1))), DEAD)

    def emitted(self, data: np.ndarray) -> np.ndarray:
        """Tokens emitted at every position of classes; -1 at the white space after a word that is not compiled."""
        width = -(-len(data) // CHUNK)
        padded = np.zeros(width * CHUNK, np.uint8)
        padded[:len(data)] = data
        steps = np.ascontiguousarray(padded.reshape(width, CHUNK).T)
        out = np.zeros((CHUNK, width), np.int16)
        state = np.full(width, DEAD, np.int64)
        for t in range(CHUNK):
            space = steps[t] == 0
            out[t] = np.where(space, self.emit[state], 0)
            state = np.where(space, ROOT, self.step(state, steps[t]))
        entry = np.concatenate([[ROOT], state[:-1]])  # composed maps: each is the constant of the chunk before
        head = np.arange(width)
        state = entry
        for t in range(CHUNK):
            space = steps[t][head] == 0
            out[t, head[space]] = self.emit[state[space]]
            head, state = head[~space], state[~space]
            if not len(head):
                break
            state = self.step(state, steps[t][head])
        return out.T.reshape(-1)[:len(data)]


def compile_words(words: list[bytes], counts: list[int]) -> Transducer:
    """Transducer of folded words and their token counts."""
    usage = Counter(b"".join(words))
    known = sorted(b for b, _ in usage.most_common(61) if b not in SPACE)
    classes = np.full(256, 63, np.uint8)
    classes[list(SPACE)] = 0
    classes[known] = np.arange(1, len(known) + 1)
    table = bytes(classes)
    coded = sorted((w, c) for w, c in ((w.translate(table), c) for w, c in zip(words, counts)) if w and len(w) <= LONGEST and 63 not in w)
    size = np.array([len(w) for w, _ in coded], np.int64)
    letters = np.zeros((len(coded), LONGEST), np.uint8)
    for d in range(LONGEST):
        long = size > d
        letters[long, d] = [w[d] for w, _ in coded if len(w) > d]
    mask, base, emit = [np.zeros(2, np.uint64)], [np.zeros(2, np.int64)], [np.array([0, -1], np.int16)]
    node, total = np.zeros(len(coded), np.int64), 2
    tokens = np.array([c for _, c in coded], np.int16)
    here_first, here = 0, 2  # numbers of the states whose children come next
    for d in range(LONGEST):
        on = size > d
        if not on.any():
            break
        parent, first = np.divmod(np.unique(node[on] * 64 + letters[on, d]), 64)
        edge = node[on] * 64 + letters[on, d]
        new = total + np.searchsorted(parent * 64 + first, edge)
        all_mask, all_base = mask[-1], base[-1]
        np.bitwise_or.at(all_mask, parent - here_first, np.uint64(1) << first.astype(np.uint64))
        start = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        all_base[parent[start] - here_first] = total + start
        node[on] = new
        here_first, here = total, len(parent)
        total += here
        mask.append(np.zeros(here, np.uint64))
        base.append(np.zeros(here, np.int64))
        ends = np.full(here, -1, np.int16)
        done = size == d + 1
        ends[node[done] - here_first] = tokens[done]
        emit.append(ends)
    return Transducer(classes, np.concatenate(mask), np.concatenate(base), np.concatenate(emit))


def lexicon(docs: DataFrame, path: str, sample_bytes: int = SAMPLE_BYTES, least: int = LEAST_COUNT) -> DataFrame:
    """(word, tokens) of the folded words that occur ``least`` times in a sample of about ``sample_bytes``, chosen by a hash of the text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    span = 1 << 30
    share = int(span * min(1.0, sample_bytes / max(size, 1)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for text in text_bytes(b):
                # A string between < and > may be special as it stands but not after folding: such words are left to the tokenizer.
                held.update(w for w in text.translate(ASCII_LOWER).split() if len(w) <= LONGEST and b"<" not in w)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [len(x) for x in encode_words(path, b.column("word").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(counts, pa.int32())], ["word", "tokens"])

    read = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(span)) < share)).select("text", F.xxhash64("text").alias("hash"))
    counted = read.dropDuplicates(["hash"]).select("text").mapInArrow(words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("word").mapInArrow(tokens, "word binary, tokens int")


def count_tokens(docs: DataFrame, path: str, sample_bytes: int = SAMPLE_BYTES, least: int = LEAST_COUNT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; null and blank texts have no tokens.  Counts are those of the tokenizers library without
    added special tokens, padding or truncation.  The compiled words are bounded by the sample: at most its bytes over 2 x ``least``.
    """
    rows = cut(lexicon(docs, path, sample_bytes, least)).toPandas()
    shipped = docs.sparkSession.sparkContext.broadcast(compile_words(rows["word"].map(bytes).tolist(), rows["tokens"].tolist()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shipped.value
        for b in batches:
            texts = [t or b"" for t in text_bytes(b)]
            counts, a = np.zeros(len(texts), np.int64), 0
            while a < len(texts):
                z, room = a, SLICE
                while z < len(texts) and (room > 0 or z == a):
                    room -= len(texts[z]) + 1
                    z += 1
                counts[a:z] = tokens_of(machine, path, texts[a:z])
                a = z
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def tokens_of(machine: Transducer, path: str, texts: list[bytes]) -> np.ndarray:
    """Tokens of every text; texts are joined by a blank, which no token crosses."""
    joined = b" ".join([*texts, b""])
    data = machine.classes[np.frombuffer(joined.translate(ASCII_LOWER), np.uint8)]
    emitted = machine.emitted(data).astype(np.int64)
    missed = np.flatnonzero(emitted < 0)
    if len(missed):
        spaces = np.flatnonzero(data == 0)
        before = np.searchsorted(spaces, missed)
        begin = np.where(before > 0, spaces[before - 1] + 1, 0)
        words = [joined[a:b] for a, b in zip(begin.tolist(), missed.tolist())]
        distinct = sorted(set(words))
        counts = dict(zip(distinct, map(len, encode_words(path, distinct))))
        emitted[missed] = [counts[w] for w in words]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    return np.add.reduceat(emitted, starts)
