"""Variable-order byte contexts as arrays, for models whose statistics are frozen.

A node is a context; ``child[node, symbol]`` is the context that reaches one symbol further back, or -1 where the training text had none.
``cost[node, symbol, column]`` holds what the model charges for a symbol after a context.  Texts are walked with NumPy gathers over all
positions at once; a position uses the longest known context before it.  Bytes that training never met share symbol 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Bytes of text that are walked at once.
SLICE = 1 << 19
PAD = 0x0A


@dataclass
class ContextMachine:
    symbol: np.ndarray  # byte -> symbol
    order: int
    child: np.ndarray  # [nodes that may have longer ones, symbols]
    cost: np.ndarray  # [nodes, symbols, columns]

    @property
    def nbytes(self) -> int:
        return self.child.nbytes + self.cost.nbytes

    def charge(self, texts: list[bytes]) -> np.ndarray:
        """Summed cost of every text, one row a text; empty texts cost nothing."""
        out = np.zeros((len(texts), self.cost.shape[2]))
        for picked in slices(texts):
            self._charge([texts[i] for i, _, _ in picked], picked, out)
        return out

    def _charge(self, texts: list[bytes], picked: list[tuple[int, int, int]], out: np.ndarray) -> None:
        pad = bytes([PAD]) * self.order
        parts, starts, at = [], [], 0
        for text, (_, a, b) in zip(texts, picked):
            parts += [pad if a == 0 else text[max(0, a - self.order):a].rjust(self.order, bytes([PAD])), text[a:b]]
            starts.append(at)
            at += self.order + b - a
        symbols = self.symbol[np.frombuffer(b"".join(parts), np.uint8)]
        width = self.child.shape[1]
        node = np.zeros(len(symbols) - self.order, np.int32)
        known = np.ones(len(node), bool)
        flat = self.child.ravel()
        for back in range(1, self.order + 1):
            nxt = flat[np.where(known, node, 0) * width + symbols[self.order - back:len(symbols) - back]]
            known &= nxt >= 0
            node = np.where(known, nxt, node)
        paid = self.cost.reshape(-1, self.cost.shape[2])[node.astype(np.int64) * width + symbols[self.order:]]
        begin = np.array(starts)
        for k in range(1, len(begin)):  # positions that belong to the pad of the next text
            paid[begin[k] - self.order:begin[k]] = 0
        sums = np.add.reduceat(paid, begin, axis=0, dtype=np.float64)
        np.add.at(out, [i for i, _, _ in picked], sums)


def slices(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text number, from, to) of at most SLICE bytes; long texts are cut, empty ones left out."""
    group, room = [], SLICE
    for i, text in enumerate(texts):
        a = 0
        while a < len(text):
            b = min(len(text), a + room)
            group.append((i, a, b))
            room -= b - a
            a = b
            if not room:
                yield group
                group, room = [], SLICE
    if group:
        yield group


def grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of bytes (last byte lowest) and their counts; each text starts after n - 1 pads."""
    pad = bytes([PAD]) * (n - 1)
    found: list[np.ndarray] = []
    times: list[np.ndarray] = []
    for picked in slices(texts):
        parts, drop, at = [], [], 0
        for i, a, b in picked:
            parts += [pad if a == 0 else texts[i][max(0, a - n + 1):a].rjust(n - 1, bytes([PAD])), texts[i][a:b]]
            drop.append(at)
            at += n - 1 + b - a
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = len(data) - n + 1
        code = np.zeros(size, np.int64)
        for k in range(n):
            code <<= 8
            code |= data[k:k + size]
        keep = np.ones(size, bool)
        for begin in drop[1:]:
            keep[begin - n + 1:begin] = False
        u, c = np.unique(code[keep], return_counts=True)
        found.append(u)
        times.append(c)
    return summed(found, times)


def coded(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code of the n-gram that ends at every byte, first place of each text, number of the text), slice by slice; as ``grams`` reads them."""
    pad = bytes([PAD]) * (n - 1)
    for picked in slices(texts):
        parts, first, at = [], [], 0
        for i, a, b in picked:
            parts += [pad if a == 0 else texts[i][max(0, a - n + 1):a].rjust(n - 1, bytes([PAD])), texts[i][a:b]]
            first.append(at)
            at += n - 1 + b - a
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = len(data) - n + 1
        code = np.zeros(size, np.int64)
        for k in range(n):
            code <<= 8
            code |= data[k:k + size]
        keep = np.ones(size, bool)
        for begin in first[1:]:
            keep[begin - n + 1:begin] = False
        starts = np.array(first) - np.arange(len(first)) * (n - 1)
        yield code[keep], starts, np.array([i for i, _, _ in picked])


def summed(found: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, inverse = np.unique(np.concatenate(found), return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, inverse, np.concatenate(times))
    return u, total


def node_table(contexts: list[np.ndarray], symbol: np.ndarray, symbols: int) -> tuple[np.ndarray, list[int]]:
    """``child`` for sorted context codes by length (index 0 is the empty context), and the first node of each length.  The longest
    contexts have no row.

    The suffix of every context must be a context too.  The oldest byte of a context is its highest.
    """
    first = [0]
    for codes in contexts:
        first.append(first[-1] + len(codes))
    child = np.full((max(1, first[-2]), symbols), -1, np.int32)
    for k in range(1, len(contexts)):
        codes = contexts[k]
        parent = first[k - 1] + np.searchsorted(contexts[k - 1], codes & ((1 << 8 * (k - 1)) - 1))
        child[parent, symbol[codes >> 8 * (k - 1)]] = first[k] + np.arange(len(codes))
    return child, first
