"""Toxicity by a linear-chain conditional random field over words.

Labels are given for documents, so words are labelled first: a word is toxic where it or one of its beginnings is far more frequent in
toxic than in other documents (smoothed log-odds, counted in Spark over the labelled sample).  The field is fitted to sentences with these
labels; its features are the word and its beginnings, its chain weighs neighbours.  Forward-backward marginals of all sentences give the
expected toxic words, their share and the largest marginal of a document; a logistic step, fitted on documents that the field has not
seen, turns them into the score.  Words with a marginal of a half or more are the offending spans.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import cut

# About so many labelled documents of either class are fitted on.
SAMPLE_DOCS = 4000
CLEAN_SHARE = 4  # of the sentences without a toxic word one in so many is fitted to, chosen by a hash
LONGEST = 48  # words of a chain; a longer sentence goes on in a new chain
BEGINNINGS = (4, 5, 6, 7, 8)
BUCKETS = 1 << 18
LEAST_COUNT, LEAST_LIFT, LEAST_Z = 5, 8.0, 4.0
ROUNDS, RATE, PULL = 80, 0.1, 1e-3
CACHED_WORDS = 400_000
STOPS = re.compile(r"[.!?]+|\n")


def features(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in BEGINNINGS if len(word) >= n]]


def chains(text: str | None) -> list[list[str]]:
    """Lower-cased words of every sentence, cut at LONGEST."""
    out: list[list[str]] = []
    for sentence in STOPS.split((text or "").lower()):
        words = re.findall(r"\w+", sentence)
        out += [words[i:i + LONGEST] for i in range(0, len(words), LONGEST)]
    return out


@dataclass
class Field:
    """Binary chain: ``weight`` of hashed features for the toxic label, ``move[a, b]`` between labels, ``start`` of the labels."""

    weight: np.ndarray
    move: np.ndarray
    start: np.ndarray
    held: dict[str, float] = field(default_factory=dict, repr=False)

    def worth(self, word: str) -> float:
        found = self.held.get(word)
        if found is None:
            if len(self.held) >= CACHED_WORDS:
                self.held.clear()
            found = self.held[word] = float(sum(self.weight[bucket(f)] for f in features(word)))
        return found


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


def padded(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[longest, chains] of the values of consecutive chains."""
    out = np.zeros((int(sizes.max(initial=0)), len(sizes)))
    chain = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes), chain] = values
    return out


def marginals(worth: np.ndarray, sizes: np.ndarray, move: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Probability of the toxic label at [longest, chains] of padded scores, by forward-backward with rescaling; also the expected label
    pairs if asked for."""
    longest, n = worth.shape
    emit = np.stack([np.ones_like(worth), np.exp(np.clip(worth, -30, 30))], 2)
    go, ahead = np.exp(move), np.zeros((longest, n, 2))
    state = np.exp(start)[None] * emit[0] if longest else np.ones((n, 2))
    for t in range(longest):
        if t:
            state = ahead[t - 1] @ go * emit[t]
        ahead[t] = state / state.sum(1, keepdims=True)
    back, expected = np.ones((n, 2)), np.zeros((2, 2))
    out = np.zeros((longest, n))
    for t in range(longest - 1, -1, -1):
        both = ahead[t] * back
        out[t] = both[:, 1] / both.sum(1)
        inside = (t < sizes)[:, None]
        if t:
            if pairs:
                joint = ahead[t - 1][:, :, None] * go[None] * (emit[t] * back)[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True))[t < sizes].sum(0)
            before = (emit[t] * back) @ go.T
            back = np.where(inside, before / before.sum(1, keepdims=True), 1.0)
    return (out, expected) if pairs else out


def fit(sentences: list[list[str]], labels: list[list[int]]) -> Field:
    """Maximum likelihood with a pull towards zero, by Adam over all sentences."""
    sizes = np.array([len(s) for s in sentences], np.int64)
    known: dict[str, list[int]] = {}
    hashed = [known.setdefault(w, None) or known.__setitem__(w, [bucket(f) for f in features(w)]) or known[w] for s in sentences for w in s]
    width = np.array([len(h) for h in hashed], np.int64)
    flat, owner = np.concatenate([np.array(h) for h in hashed]), np.repeat(np.arange(len(hashed)), width)
    truth = np.concatenate([np.array(x) for x in labels]).astype(float)
    chain = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashed)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    used, flat = np.unique(flat, return_inverse=True)
    follows = place > 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[np.flatnonzero(follows) - 1].astype(int), truth[follows].astype(int)), 1)
    first = np.bincount(truth[place == 0].astype(int), minlength=2)
    theta = np.zeros(len(used) + 6)
    theta[:len(used)] = -0.1
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    groups = [np.flatnonzero((sizes > a) & (sizes <= b)) for a, b in ((0, 8), (8, 16), (16, 32), (32, LONGEST))]
    inside = [np.isin(chain, g) for g in groups]
    for step in range(1, ROUNDS + 1):
        worth = np.bincount(owner, theta[flat], minlength=len(hashed))
        move, start = theta[-6:-2].reshape(2, 2), theta[-2:]
        p, expected, begun = np.zeros(len(hashed)), np.zeros((2, 2)), 0.0
        for g, own in zip(groups, inside):
            if len(g):
                out, pair = marginals(padded(worth[own], sizes[g]), sizes[g], move, start, pairs=True)
                p[own] = out[place[own], np.searchsorted(g, chain[own])]
                expected, begun = expected + pair, begun + out[0].sum()
        slope = np.concatenate([np.bincount(flat, (truth - p)[owner], minlength=len(used)), (seen - expected).ravel(), [first[0] - (len(sizes) - begun), first[1] - begun]])
        slope = slope / len(sizes) - PULL * theta / len(used) ** 0.5
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope ** 2
        theta = theta + RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = theta[:len(used)]
    return Field(weight, theta[-6:-2].reshape(2, 2), theta[-2:])


def tag(model: Field, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Per text: words, expected toxic words and the largest marginal; and the spans (from, to, marginal) in characters of the lower-cased text."""
    numbers = np.zeros((len(texts), 3))
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    all_chains, owner = [], []
    for i, text in enumerate(texts):
        found = chains(text)
        all_chains += found
        owner += [i] * len(found)
    if not all_chains:
        return numbers, spans
    sizes, owner = np.array([len(c) for c in all_chains], np.int64), np.array(owner, np.int64)
    worth = np.fromiter((model.worth(w) for c in all_chains for w in c), np.float64, int(sizes.sum()))
    chain = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(worth)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    p = np.zeros(len(worth))
    for a, b in ((0, 8), (8, 16), (16, 32), (32, LONGEST)):
        g = np.flatnonzero((sizes > a) & (sizes <= b))
        if len(g):
            own = (sizes[chain] > a) & (sizes[chain] <= b)
            p[own] = marginals(padded(worth[own], sizes[g]), sizes[g], model.move, model.start)[place[own], np.searchsorted(g, chain[own])]
    of = owner[chain]
    numbers[:, 0] = np.bincount(of, minlength=len(texts))
    numbers[:, 1] = np.bincount(of, p, minlength=len(texts))
    np.maximum.at(numbers[:, 2], of, p)
    begin = np.searchsorted(of, np.arange(len(texts)))
    for i in np.unique(of[p >= 0.5]).tolist():
        places = [m.span() for s in _sentences(texts[i].lower()) for m in s]
        spans[i] = [(*places[k - begin[i]], float(p[k])) for k in begin[i] + np.flatnonzero(p[begin[i]:begin[i] + len(places)] >= 0.5)]
    return numbers, spans


def _sentences(text: str) -> Iterator[list[re.Match]]:
    at = 0
    words = re.compile(r"\w+")
    for stop in [*STOPS.finditer(text), None]:
        end = stop.start() if stop else len(text)
        yield list(words.finditer(text, at, end))
        at = stop.end() if stop else end


def evidence(numbers: np.ndarray) -> np.ndarray:
    words, expected, largest = numbers.T
    return np.stack([np.ones(len(words)), np.log1p(expected), np.log1p(100 * expected / np.maximum(words, 20)), largest], 1)


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, with a small pull towards zero."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = x.T * (p * (1 - p)) @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * w)
    return w


def sample(labelled: DataFrame, docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, toxic): about ``docs`` ids of either class, chosen by a hash; an id with several labels is toxic if one says so."""
    rows = labelled.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    span = 1 << 30
    chosen = F.lit(False)
    for value in (0, 1):
        chosen = chosen | ((F.col("toxic") == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(span * min(1.0, docs / max(1, sizes.get(value, 0))))))
    return rows.where(chosen)


def toxic_features(texts: DataFrame) -> set[str]:
    """Features far more frequent in toxic than in other texts of (text, toxic): count, lift and z over their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter(), Counter()]
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                held[toxic].update(f for c in chains(text) for w in c for f in features(w))
        keys = list(held[0] | held[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([held[k][x] for x in keys], pa.int64()) for k in (0, 1)]], ["feature", "clean", "toxic"])

    counts = cut(texts.mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    whole = counts.where("feature like '=%'").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    n0, n1 = float(whole["clean"] or 1), float(whole["toxic"] or 1)
    lift = F.log((F.col("toxic") + 0.5) / n1) - F.log((F.col("clean") + 0.5) / n0)
    z = lift / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    return {r["feature"] for r in counts.where((F.col("toxic") >= LEAST_COUNT) & (lift >= float(np.log(LEAST_LIFT))) & (z >= LEAST_Z)).select("feature").toLocalIterator()}


def learn(docs: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[Field, np.ndarray] | None:
    """The field and the logistic weights, from (doc_id, text) and (doc_id, toxic); None without labelled texts of both classes."""
    chosen = cut(sample(labelled, sample_docs))
    # A hash draws about as many ids as asked for; well within twice as many they may be shipped, and no text is shuffled for them.
    chosen = F.broadcast(chosen) if chosen.count() <= 4 * sample_docs else chosen
    texts = cut(docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id")
                .select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("later")))
    first = texts.where("not later")
    marked = toxic_features(first.select("text", "toxic"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, str] = {}
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                for c in chains(text):
                    labels = "".join("1" if toxic and not marked.isdisjoint(features(w)) else "0" for w in c)
                    words = " ".join(c)
                    if "1" in labels or zlib.crc32(words.encode("utf-8", "replace")) % CLEAN_SHARE == 0:
                        held[words] = labels
        rows = list(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["words", "labels"])

    rows = first.select("text", "toxic").mapInArrow(lines, "words string, labels string").toPandas().drop_duplicates("words").sort_values("words")
    if rows.empty or not rows["labels"].str.contains("1").any():
        return None
    model = fit([w.split(" ") for w in rows["words"]], [[int(x) for x in y] for y in rows["labels"]])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, _ = tag(shipped.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(numbers.T)), b.column("toxic")], ["words", "expected", "largest", "toxic"])

    found: pd.DataFrame = texts.where("later").select("text", "toxic").mapInArrow(measure, "words double, expected double, largest double, toxic int").toPandas()
    if found["toxic"].nunique() < 2:
        return None
    return model, calibrate(evidence(found[["words", "expected", "largest"]].to_numpy()), found["toxic"].to_numpy(float))


def toxicity(docs: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, score, words, toxic_words, spans) of every row of ``docs``, learnt from (doc_id, toxic) of ``labelled``.

    ``spans`` are (start, end, marginal) in characters.  Null, empty and wordless texts get the score of no evidence; without labelled texts of
    both classes every score is 0.  Whole texts are tagged; repeated rows score alike.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    learnt = learn(docs, labelled, sample_docs)
    shape = "array<struct<start:int,end:int,marginal:double>>"
    if learnt is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("words"), F.lit(0.0).alias("toxic_words"), F.expr(f"cast(array() as {shape})").alias("spans"))
    shipped = docs.sparkSession.sparkContext.broadcast(learnt)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shipped.value
        for whole in batches:
            for a in range(0, len(whole), 500):
                b = whole.slice(a, 500)
                numbers, spans = tag(model, b.column("text").to_pylist())
                score = 1 / (1 + np.exp(-np.clip(evidence(numbers) @ weights, -30, 30)))
                found = pa.array([[{"start": x, "end": y, "marginal": p} for x, y, p in s] for s in spans], arrow)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(numbers[:, 0].astype("i8")), pa.array(numbers[:, 1]), found],
                                                 ["doc_id", "score", "words", "toxic_words", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, words long, toxic_words double, spans {shape}")
