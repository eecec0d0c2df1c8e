"""Spelling variants by variable grams against all deletions and replacements."""

from collections import Counter, defaultdict
import random
import re
import zlib

import numpy as np
import pytest

from studyloom.llm import packing, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near_words(words):
    """All pairs one edit apart: words that are equal with one place blanked, or one of them without it."""
    near, blank = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            blank[w[:i], w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for w in words:
        for i in range(len(w)):
            near[w] |= blank[w[:i], w[i + 1:]] - {w}
    return near


def plain(rows):
    words = vocabulary(rows)
    near = near_words(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words[form[w]] if w in form else -1) for w, n in words.items())


def grouped(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in variants.group_variants(df).collect())


def made_up(seed, n):
    """Words of few syllables, so grams are shared by many, with edits of each other."""
    rng = random.Random(seed)
    parts = ["tion", "ing", "er", "an", "ß", "é", "ö", "ly", "in", "a", "st", "qu", "aa"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(n)]
    words = []
    for w in base:
        words += [w] * rng.randint(1, 9)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            words += [w[:i] + rng.choice("abé") + w[i + rng.randint(0, 1):]] * rng.randint(1, 12)
    rng.shuffle(words)
    return [(i, " ".join(w.capitalize() if rng.random() < 0.2 else w for w in words[i * 40:i * 40 + 40])) for i in range(len(words) // 40 + 1)]


@pytest.mark.parametrize("least, part", [(16, 1024), (2, 8), (1000, 64)])
def test_equals_all_pairs(spark, monkeypatch, least, part):
    """With few, many and no frequent grams, and with lists cut into many parts."""
    monkeypatch.setattr(variants, "LEAST_WORDS", least)
    monkeypatch.setattr(variants.dictionary, "__defaults__", (least, variants.GRAMS))
    monkeypatch.setattr(variants.near_pairs, "__defaults__", (part,))
    rows = made_up(least, 500)
    assert grouped(spark, rows) == plain(rows) and len(plain(rows)) > 300


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 64)
    long = "ab" * 400
    rows = [(1, None), (2, ""), (3, "1234 ---"), (None, "Straße straße STRASSE"), (4, "straße " * 4), (4, "straße " * 4), (5, f"{long} " * 3 + f"{long}c " * 7),
            (6, "abcdé abcdé abcdé abcde abcde abcde"), (7, "zzzzz " * 3 + "zzzzzz " * 6 + "zzzzzzz " * 20 + "zzzz " * 9), (8, "a×b÷c" * 3 + " a×b÷c" * 5)]
    rows += [(100 + i, "repeated words everywhere") for i in range(120)]  # shortened in some documents
    assert grouped(spark, rows) == plain(rows)
    assert grouped(spark, []) == [] and grouped(spark, [(1, None)]) == []


def test_counting_forgets_and_adds_up(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 50)
    rows = made_up(9, 80)
    got = {r.word: r.n for r in variants.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == vocabulary(rows)


def test_edits_leave_as_many_grams_as_the_bound_says():
    """The definition of the bound: every edit of a word keeps all but ``affected`` of its grams, at their distance from start or end."""
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 14))) for _ in range(60)]
    marked = variants.Words([w.encode() for w in words])
    code, n = np.unique(np.concatenate([marked.code[k][marked.fits(k)] for k in range(2, 7)]), return_counts=True)
    known = variants.Dictionary(code[n > 12], n[n > 12])

    def grams(raw, longest):
        m = variants.Words([raw])
        _, place, _, code, affected = variants.decompose(m, known, longest)
        return {(int(c), int(p)) for c, p in zip(code, place)}, {(int(c), len(raw) + 2 - int(p)) for c, p in zip(code, place)}, int(affected[0])

    for w in words:
        for i in range(len(w) + 1):
            for c in "abz":
                for other in {w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]} - {w}:
                    if len(other) < 5:
                        continue
                    longest = int(variants.scale_of(np.array([min(len(w), len(other))]))[0])
                    start, end, affected = grams(w.encode(), longest)
                    other_start, other_end, _ = grams(other.encode(), longest)
                    kept = {p for c_, p in start & other_start} | {len(w) + 2 - p for c_, p in end & other_end}
                    assert len(kept) >= len(start) - affected >= 1
