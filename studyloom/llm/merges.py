"""Byte-pair merges of a public word tokenizer over many distinct words at once.

Text of printable ASCII and Latin-1 letters is lowered and split by the tokenizer's own rule; all distinct pieces are merged together, row by
row of a matrix, lowest rank first.  Words (between ASCII white space) with any other character or with something like a special token, and
very long pieces, are left to the tokenizers library.
"""

from __future__ import annotations

from functools import lru_cache
import json
import re

import numpy as np

from studyloom.llm.word_bpe import encode_words

# Pieces merged in one matrix, and the longest one that is.
ROWS, LONGEST = 1 << 13, 128
# Distinct pieces and words that a task remembers; beyond, it forgets them all and meets them anew.
REMEMBERED = 400_000
NONE = np.iinfo(np.int32).max

# The tokenizer's splitting rule for lowered printable ASCII and Latin-1 letters.
ODD = re.compile(r"[^ \t\n\r\x0b\x0c!-~À-ÖØ-öø-ÿ]")
SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable bytes for themselves, the others for characters from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Merger:
    """Merge table of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.path = path
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.last = np.array([vocab[c + END] for c in byte_symbols()], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        rank = np.argsort(keys)
        self.keys, self.rank = keys[rank], rank.astype(np.int32)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.known: dict[str, bytes] = {}  # pieces
        self.words: dict[str, bytes] = {}  # whole words, where their texts hold odd characters

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece, as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.array([len(p) for p in pieces])
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), ROWS):
            self._merge_rows(pieces, order[a:a + ROWS], size, out)
        return out

    def _merge_rows(self, pieces: list[bytes], rows: np.ndarray, size: np.ndarray, out: list[bytes]) -> None:
        width = int(size[rows[-1]])
        data = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(len(rows), width)
        place, end = np.arange(width + 1), size[rows]
        ids = np.full((len(rows), width + 1), -1, np.int32)  # one column more than a piece has symbols
        ids[:, :width] = np.where(place[:width] < end[:, None], self.inner[data], -1)
        every = np.arange(len(rows))
        ids[every, end - 1] = self.last[data[every, end - 1]]
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :width] = self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)
            every = np.arange(len(rows))
            best = rank[every, at]
            ready = best == NONE
            if ready.any():
                done = ids[ready]
                there = done >= 0
                flat, ends = done[there].astype("<u4").tobytes(), np.cumsum(there.sum(axis=1)).tolist()
                a = 0
                for i, z in zip(rows[ready].tolist(), ends):
                    out[i] = flat[4 * a:4 * z]
                    a = z
                rows, ids, rank, at, best = rows[~ready], ids[~ready], rank[~ready], at[~ready], best[~ready]
                every = np.arange(len(rows))
                if not len(rows):
                    return
            move = np.minimum(place + (place > at[:, None]), width)
            ids, rank = np.take_along_axis(ids, move, axis=1), np.take_along_axis(rank, move, axis=1)
            ids[:, width], rank[:, width] = -1, NONE
            ids[every, at] = self.joined[best]
            rank[every, at] = self._rank(ids[every, at], ids[every, np.minimum(at + 1, width)])
            before = np.maximum(at - 1, 0)
            rank[every, before] = np.where(at > 0, self._rank(ids[every, before], ids[every, at]), rank[every, before])

    def encode(self, parts: list[bytes]) -> list[bytes]:
        """Ids of every part of a text; parts are cut at ASCII white space."""
        if len(self.known) + len(self.words) > REMEMBERED:
            self.known.clear()
            self.words.clear()
        texts = [p.decode("utf-8", "replace") for p in parts]
        plain = [not ODD.search(t) and "<|" not in t for t in texts]
        found = [PIECES.findall(t.lower()) if ok else _split(p) for p, t, ok in zip(parts, texts, plain)]
        pieces: set[str] = set()
        words: set[str] = set()
        get, known = self.known.get, self.words.get
        ids = [list(map(get if ok else known, own)) for own, ok in zip(found, plain)]
        for own, met, ok in zip(found, ids, plain):
            if None in met:
                (pieces if ok else words).update([x for x, i in zip(own, met) if i is None])
        self._learn(pieces, words)
        return [b"".join(met if None not in met else map(get if ok else known, own)) for own, met, ok in zip(found, ids, plain)]

    def _learn(self, pieces: set[str], words: set[str]) -> None:
        """Each distinct piece and word is encoded when it is met first."""
        split = {w: PIECES.findall(w.lower()) for w in words if SIMPLE.fullmatch(w) and "<|" not in w}
        fresh = {p: p.encode() for p in pieces.union(*split.values()) if p not in self.known}
        short = [p for p, raw in fresh.items() if len(raw) <= LONGEST]
        self.known.update(zip(short, self.merge([fresh[p] for p in short])))
        odd = [w for w in words if w not in split]
        long = [p for p, raw in fresh.items() if len(raw) > LONGEST]
        met = [np.array(x, "<u4").tobytes() for x in encode_words(self.path, [w.encode() for w in [*odd, *long]])]
        self.words.update(zip(odd, met))
        self.known.update(zip(long, met[len(odd):]))
        self.words.update((w, b"".join([self.known[p] for p in own])) for w, own in split.items())


def _split(part: bytes) -> list[str]:
    """Words between ASCII white space; Python's own split of a string would take other characters for blanks too."""
    return [w.decode("utf-8", "replace") for w in part.split()]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """Merge table of a file, once a process."""
    return Merger(path)
