"""Spelling variants by an index of variable-length grams.

Dictionary: a gram is extended by one more character while more words hold it than a bound, so frequent grams grow and rare ones stay short;
the bound rises with the vocabulary, which keeps the dictionary of frequent grams small enough to ship whatever the number of words.

Decomposition: at every place of a word (with marks before and after) the longest gram of the dictionary, left out where the gram before
already reaches as far.  Substrings are never rarer than what holds them, so these ends never fall back, and a gram depends on nothing but
its own characters and the one before.  One edit therefore touches the grams that cover its place from the character after, or before, them;
the largest number of grams over all places is the word's bound of affected grams.

Merging: two words one edit apart share all grams that the edit leaves alone, at the same distance from the start or from the end.  The rarest
of these is among the rarest ``bound + 1`` grams of either word, so only these lists are met.  Gram lengths are limited to half of a word,
so that an edit always leaves one.  What meets is verified character by character.
"""

from __future__ import annotations

from collections.abc import Iterator
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import ASCII_LOWER, stored, text_bytes
from studyloom.llm.packing import slices

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, EVERY, OUTWEIGHS = 5, 3, 97, 2
# Grams have two characters at least and so many at most; frequent grams are held by more words than LEAST_WORDS, and there are at most GRAMS.
SHORTEST, LONGEST = 2, 6
LEAST_WORDS, GRAMS = 16, 200_000
# Distinct words a task counts before it passes them on.
HELD = 300_000
# Words of a list that are met at once; longer lists are cut into parts.
PART = 1024
# Words up to this length are compared as rows of a matrix.
WIDE = 48
BEFORE, AFTER = b"\x01", b"\x02"


# --------------------------------------------------------------------------------------------- words
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def shortened(run: str, h: int) -> str:
    at = h % len(run)
    return run[:at] + run[at + 1:]


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of all runs, one in EVERY of the (document, run) pairs by one character shorter; every task adds up its own.

    The checksum of ``<doc_id>:<run>`` is that of the run alone, xor the checksum of the prefix moved on by as many zero bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        total, crc, size, other = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), {}

        def emit() -> pa.RecordBatch:
            words, counts = [*number, *other], [*total.tolist(), *other.values()]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for b in batches:
            names = b.column("name").to_pylist()
            for group in slices([t or b"" for t in text_bytes(b)]):
                docs_, found = [], []
                for i, part in group:
                    runs = RUN.findall(part.translate(ASCII_LOWER).decode("utf-8", "replace"))
                    found.append(np.fromiter((number.setdefault(r, len(number)) for r in runs), np.int64, len(runs)))
                    docs_.append(i)
                if len(number) > len(total):
                    fresh = [w.encode() for w in list(number)[len(total):]]
                    crc = np.concatenate([crc, np.array([zlib.crc32(w) for w in fresh], np.uint32)])
                    size = np.concatenate([size, np.array([len(w) for w in fresh])])
                    total = np.concatenate([total, np.zeros(len(fresh), np.int64)])
                words = np.concatenate(found)
                doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
                seeds = np.array([zlib.crc32(f"{names[i]}:".encode()) for i in docs_], np.uint32)
                hit = np.zeros(len(words), bool)
                length, seed = size[words], seeds.copy()
                for bytes_ in range(1, min(WIDE, int(length.max(initial=0))) + 1):
                    seed = (seed >> 8) ^ CRC[seed & 255]
                    here = np.flatnonzero(length == bytes_)
                    hit[here] = (crc[words[here]] ^ seed[doc[here]]) % EVERY == 0
                known = list(number)
                for here in np.flatnonzero(length > WIDE):
                    hit[here] = zlib.crc32(known[words[here]].encode(), int(seeds[doc[here]])) % EVERY == 0
                total += np.bincount(words[~hit], minlength=len(total))
                for w, d in zip(words[hit].tolist(), doc[hit].tolist()):
                    word = known[w]
                    word = shortened(word, zlib.crc32(word.encode(), int(seeds[d])))
                    other[word] = other.get(word, 0) + 1
                if len(number) + len(other) > HELD:
                    yield emit()
                    number, other = {}, {}
                    total, crc, size = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        yield emit()

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    return named.mapInArrow(run, "word string, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    return counted(docs).where((F.col("n") >= least_count) & (F.length("word") >= least_length))


# --------------------------------------------------------------------------------------------- grams
class Words:
    """Words of one batch, marked, end to end, and the code of the gram of every length at every place."""

    def __init__(self, words: list[bytes], longest: int = LONGEST):
        self.chars = np.frombuffer(b"".join([BEFORE + w + AFTER for w in words]), np.uint8).astype(np.int64)
        self.size = np.array([len(w) + 2 for w in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.end = np.repeat(self.first + self.size, self.size)
        self.code = {1: self.chars}
        for k in range(2, longest + 1):
            code = np.zeros(len(self.chars), np.int64)
            code[:-k + 1] = self.code[k - 1][:-k + 1] << 8 | self.chars[k - 1:]
            self.code[k] = code

    def fits(self, k: int) -> np.ndarray:
        return np.arange(len(self.chars)) + k <= self.end


class Dictionary:
    """Frequent grams and the number of their places, by code."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order]

    def count(self, code: np.ndarray) -> np.ndarray:
        """Places of every gram; a gram that is not frequent has none."""
        if not len(self.codes):
            return np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.counts[at], 0)


def decompose(words: Words, known: Dictionary, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, length, code, affected) of the grams of all words; ``affected`` is one number a word: the grams that one edit can touch,
    at most."""
    place = np.arange(len(words.chars))
    starts = words.fits(SHORTEST)
    length = np.where(starts, SHORTEST, 0)
    code = words.code[SHORTEST].copy()
    for k in range(SHORTEST, longest):
        longer = np.flatnonzero((length == k) & words.fits(k + 1))
        longer = longer[known.count(code[longer]) > 0]
        length[longer], code[longer] = k + 1, words.code[k + 1][longer]
    end = place + length
    further = np.ones(len(place), bool)
    further[1:] = (end[1:] > end[:-1]) | (words.word[1:] != words.word[:-1])
    at = np.flatnonzero(starts & further)
    change = np.zeros(len(place) + 1, np.int64)
    np.add.at(change, np.maximum(at - 1, words.first[words.word[at]]), 1)
    np.add.at(change, end[at], -1)
    affected = np.maximum.reduceat(np.cumsum(change)[:-1], words.first)
    return words.word[at], at - words.first[words.word[at]], length[at], code[at], affected


def rarest(words: Words, known: Dictionary, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, length, code) of the rarest grams of every word, one more than an edit can touch."""
    word, place, length, code, affected = decompose(words, known, longest)
    order = np.lexsort((place, code, known.count(code), word))
    word, place, length, code = word[order], place[order], length[order], code[order]
    new = np.ones(len(word), bool)
    new[1:] = word[1:] != word[:-1]
    rank = np.arange(len(word)) - np.maximum.accumulate(np.where(new, np.arange(len(word)), 0))
    kept = rank <= affected[word]
    return word[kept], place[kept], length[kept], code[kept]


def scale_of(length: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Longest gram for pairs whose shorter word has this length: an edit leaves the first or the last gram alone."""
    return np.minimum(longest, (length + 1) // 2)


def dictionary(words: DataFrame, least_words: int = LEAST_WORDS, grams: int = GRAMS) -> Dictionary:
    """Grams at more places than ``least_words`` and than one in ``grams`` of all places, so at most ``grams`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                marked = Words(b.column("raw").to_pylist())
                code, n = np.unique(np.concatenate([marked.code[k][marked.fits(k)] for k in range(SHORTEST, LONGEST + 1)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    places = words.agg(F.sum(F.octet_length("raw") + 2)).first()[0] or 0
    bound = max(least_words, -(-int(places) * (LONGEST - SHORTEST + 1) // grams))
    found = words.select("raw").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > bound).toPandas()
    return Dictionary(found["code"].to_numpy("i8"), found["n"].to_numpy("i8"))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit key of several numbers; words that meet by chance are told apart when they are verified."""
    key = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def posted(words: DataFrame, known: Dictionary) -> DataFrame:
    """(key, raw, n, letters): every word under its rarest grams, once by the distance from the start and once from the end.

    ``letters`` has a bit for each letter that occurs an odd number of times; an edit changes two of them at most.
    """
    shipped = words.sparkSession.sparkContext.broadcast((known.codes, known.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Dictionary(*shipped.value)
        for b in batches:
            raw, length = b.column("raw").to_pylist(), np.array([len(w) for w in b.column("raw").to_pylist()], np.int64)
            for scale in range((LEAST_LENGTH + 1) // 2, LONGEST + 1):
                own = np.flatnonzero((scale_of(length) == scale) | ((scale_of(length - 1) == scale) & (length > LEAST_LENGTH)))
                if not len(own):
                    continue
                marked = Words([raw[i] for i in own])
                word, place, _, code = rarest(marked, grams, scale)
                from_end = marked.size[word] - place
                letters = np.bitwise_xor.reduceat(np.uint64(1) << (marked.chars & 63).astype(np.uint64), marked.first).view(np.int64)
                one = np.ones(len(word), np.int64)
                key = np.concatenate([_mixed(code, place, scale * one), _mixed(code, from_end, -scale * one)])
                word = np.concatenate([word, word])
                rows = b.take(pa.array(own[word]))
                yield pa.RecordBatch.from_arrays([pa.array(key), rows.column("raw"), rows.column("n"), pa.array(letters[word])], ["key", "raw", "n", "letters"])

    return words.select("raw", "n").mapInArrow(run, "key long, raw binary, n long, letters long")


# --------------------------------------------------------------------------------------------- near words
def one_edit(a: np.ndarray, b: np.ndarray, size: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """True where row b is row a with one character replaced (equal sizes) or one more character (``longer``); rows are padded with zeros.

    ``size`` are the sizes of ``a``.
    """
    differ = a != b
    same = ~longer & (differ.sum(axis=1) == 1)
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    moved = (a[:, :-1] != b[:, 1:]) & (np.arange(a.shape[1] - 1) < size[:, None])
    last = np.where(moved.any(axis=1), moved.shape[1] - 1 - moved[:, ::-1].argmax(axis=1), -1)
    return same | (longer & (last < first))


def one_edit_apart(a: bytes, b: bytes) -> bool:
    """The same for two words of any length, ``a`` not longer than ``b``."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(b) - len(a) > 1:
        return False
    width = len(b) + 1
    rows = [np.pad(v, (0, width - len(v)))[None] for v in (x, y)]
    return bool(one_edit(*rows, np.array([len(a)]), np.array([len(b) > len(a)]))[0])


def near_in_groups(group: np.ndarray, raw: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of at most one character's difference in length, shorter first) one edit apart in the same group; rows are sorted by
    group and length."""
    size = np.array([len(w) for w in raw])
    width = min(WIDE, int(size.max(initial=0))) + 2
    rows = np.frombuffer(b"".join([w[:width].ljust(width, b"\0") for w in raw]), np.uint8).reshape(len(raw), width)
    at, step, left, right = np.arange(len(group)), 1, [], []
    while len(at):
        at = at[at + step < len(group)]
        at = at[(group[at] == group[at + step]) & (size[at + step] - size[at] <= 1)]  # lengths only grow along a group
        maybe = at[np.bitwise_count((letters[at] ^ letters[at + step]).view(np.uint64)) <= 2]
        if len(maybe):
            other = maybe + step
            wide = size[other] >= width
            fine = np.zeros(len(maybe), bool)
            low = np.flatnonzero(~wide)
            fine[low] = one_edit(rows[maybe[low]], rows[other[low]], size[maybe[low]], size[other[low]] > size[maybe[low]])
            for k in np.flatnonzero(wide):
                fine[k] = raw[maybe[k]] != raw[other[k]] and one_edit_apart(raw[maybe[k]], raw[other[k]])
            left.append(maybe[fine])
            right.append(other[fine])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest: pa.Table | None = None

    def emit(rows: pa.Table) -> pa.RecordBatch:
        a, b = near_in_groups(rows["group"].to_numpy(), rows["raw"].to_pylist(), rows["letters"].to_numpy())
        left, right = rows.take(pa.array(a)), rows.take(pa.array(b))
        columns = [left["raw"], left["n"], right["raw"], right["n"]]
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], ["a", "a_n", "b", "b_n"])

    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None and len(rest) else rows
        group = rows["group"].to_numpy()
        a = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
        rest = rows.slice(a)
        if a:
            yield emit(rows.slice(0, a))
    if rest is not None and len(rest):
        yield emit(rest)


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """Distinct (a, a_n, b, b_n) of words (raw, n) one edit apart, each pair once, as Latin-1 bytes."""
    rows = posted(words, dictionary(words))
    shared = rows.groupBy("key").agg(F.count("*").alias("n_words")).where("n_words > 1")
    parts = F.ceil(F.col("n_words") / part).cast("int")
    own = F.pmod(F.xxhash64("raw"), parts).cast("int")
    met = (rows.join(shared, "key").select("key", "raw", "n", "letters", parts.alias("parts"), own.alias("own"))
           .select("key", "raw", "n", "letters", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
           .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "raw", "n", "letters"))
    grouped = met.repartition("group").sortWithinPartitions("group", F.length("raw"), "raw")
    return grouped.mapInArrow(_verified, "a binary, a_n long, b binary, b_n long").distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): forms are followed by doubling steps.

    Counts at least double along a chain, so there are no circles and under 64 links to a root.
    """
    now = stored(links.select("word", F.col("form").alias("root")))
    for _ in range(7):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = now.join(onward, "root", "left")
        now = stored(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if not now.where("_moved").limit(1).count():
            break
    return now.select("word", "root")


def group_variants(docs: DataFrame, outweighs: int = OUTWEIGHS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    Null and empty texts hold no words; a null id counts as an empty one; repeated rows count as often as they occur; texts of any length are
    read in slices; ties of counts go to the first word in code-point order; an empty table gives no rows; columns other than doc_id and
    text are not read.
    """
    words = stored(vocabulary(docs))
    raw = words.select(F.encode("word", "ISO-8859-1").alias("raw"), "n")
    pairs = stored(near_pairs(raw))
    text = lambda c: F.decode(c, "ISO-8859-1")
    both = pairs.select(text("a").alias("word"), text("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(text("b").alias("word"), text("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    outweighed = -F.col("best.less") >= outweighs * F.col("n")
    formed = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                            F.when(outweighed, F.col("best.near")).alias("form"), F.when(outweighed, -F.col("best.less")).alias("form_n")))
    followed = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
