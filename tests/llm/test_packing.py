"""Packing: pieces against the tokenizers library, placement against its rule."""

from collections import defaultdict
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from studyloom.llm import merges, packing
from studyloom.llm.word_bpe import tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", "it's 'S DON'T 'sun ''s !'s a'b", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ ς ŉ", " x\u0085y z w", "x" * 300 + " " + "!" * 200 + " é" * 9,
       "1234567 ١٢ x²½", "\x00\x01\x1c\x1dabc\x7f", "日本語 한국어 😀👍🏽", "é ́a", "ß ẞ ÿ Ÿ × ÷ ¡ ª º µ", "'RE'VE'M'LL'D", "abc…def—ghi", "ﬁ ﬃ", "A\tB\nC\x0bD\x0cE\rF"]


def library(texts):
    return [e.ids for e in tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abc'sS!1é <|À\t\n ́ß中") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts([t.encode() for t in texts], PATH)] == library(texts)


def test_long_texts_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 50)
    monkeypatch.setattr(merges, "REMEMBERED", 20)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcde,é") for _ in range(rng.randint(1, 9))) for _ in range(400)), "y" * 700, "", "z " * 300]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts([t.encode() for t in texts], PATH)] == library(texts)


def slow_place(lengths, limit):
    """The rule itself: squares of the numbers of open sequences by gap are added up anew for every choice."""
    gaps, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        count = defaultdict(int)
        for g in gaps:
            count[g] += 1
        best = None
        for g in sorted(g for g in count if g >= lengths[i] and g) + [limit]:
            after = dict(count)
            if g in after and g != limit:
                after[g] -= 1
            left = g - lengths[i]
            if left:
                after[left] = after.get(left, 0) + 1
            total = sum(n * n for k, n in after.items() if k)
            if best is None or total < best[0]:
                best = (total, g)
        g = best[1]
        if g == limit:
            gaps.append(limit - lengths[i])
        else:
            gaps[gaps.index(g)] -= lengths[i]
        out.append((lengths[i], g))
    return sorted(gaps), out


@pytest.mark.parametrize("seed", range(4))
def test_pieces_go_where_squares_are_least(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 7, 11, 20, 31, 32, rng.randint(1, 32)]) for _ in range(120)]
    number, offset, lacks = packing.place(np.array(lengths), 32)
    assert sorted(lacks.tolist()) == slow_place(lengths, 32)[0]
    for s in range(number.max() + 1):
        at = 0
        for o, n in sorted((offset[i], lengths[i]) for i in np.flatnonzero(number == s)):
            assert o == at
            at += n
        assert at + lacks[s] == 32


def packs(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, sequence_id string, _shard int").repartition(3)
    return packing.pack(df, PATH, **options).collect()


@pytest.mark.parametrize("shard", [1 << 16, 40])
def test_every_token_has_its_place(spark, shard):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "x9", "été", "!"]) for _ in range(int(rng.paretovariate(0.8)) % 400)) for _ in range(300)] + [None, "", "word " * 5000]
    rows = list(enumerate(texts)) + [(None, "null id"), (None, "null id"), (7, texts[7])]  # null and repeated rows are documents too
    got = packs(spark, rows, shard=shard, limit=64)
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    expected = []
    for (i, _), ids in zip(rows, library([t or "" for _, t in rows])):
        ids = np.array([*ids, 0], "<u4")
        expected += [(i is None, i or 0, k, a, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert pieces == sorted(expected)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    total = sum(r.length for r in got)
    assert -(-total // 64) <= len(held) <= -(-total // 64) * 1.03 + 2  # shards cost next to nothing


def test_no_documents(spark):
    assert packs(spark, []) == []
