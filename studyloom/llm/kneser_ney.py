"""Quality by an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted texts of each language.

Counts: every task sums its n-grams, then one shuffle by (language, n-gram).  Shorter orders use continuation counts, the number of
distinct bytes before a gram.  Discounts come from the counts of counts of a language and order.  Probabilities come from joins of the
count tables, sharded by (language, context): a gram with the totals of its context, then with its own suffix one order below.

Scoring: documents are dealt into units of bounded size, whose texts travel once, in compressed blocks.  A unit posts its distinct n-grams, sorted,
to the shards of the tables; a shard finds the cost of each by the longest gram it holds, and sends the costs back by position.  Tables are
sharded by language and the last bytes of the context, which a gram shares with all its suffixes and contexts; the few grams that are too
short for that are in every shard.  Nothing of the model or of the texts passes the driver, whatever their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.common import cut, let_go, stored, text_bytes
from studyloom.llm.contexts import coded
from studyloom.llm.ppm import count_grams
from studyloom.llm.word_bpe import packed, unpacked

ORDER = 5
# Bytes of text in a unit, about; shards of the tables at most, fewer where there are fewer units.
UNIT_BYTES, SHARDS = 16_000_000, 1024
# How hard blocks are compressed: texts are shuffled once, and that is most of the disk.
PACKED = 6
# Last bytes of a context that choose its shard.
SHARED = 2
# Texts are judged as if this many bytes of average trusted text stood beside them, so a few odd bytes do not decide a short text.
PRIOR_BYTES = 40
# A text goes if its rate is over this quantile of the language's trusted texts by more than the margin (nats a byte).
QUANTILE = 0.99
MARGIN = 0.05
# One in so many trusted texts, by a hash of the text, sets the quantile and stays out of the counts.
HELD_OUT = 5


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def tables(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Model tables from (lang, gram, n) of the highest order.

    ``grams``: (lang, size, gram, p), interpolated probability of the last byte after the others.
    ``contexts``: (lang, size, context, gamma), weight of the shorter order after a context of ``size`` bytes.
    """
    by_order = {order: counts.withColumnRenamed("n", "c")}
    for k in range(order - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        by_order[k] = stored(by_order[k + 1].select("lang", low.alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c")))
    probabilities, weights, below = [], [], None
    for k in range(1, order + 1):
        number = lambda i: F.count(F.when(F.col("c") == i, 1))
        n1, n2, n3, n4 = (F.col(f"n{i}").cast("double") for i in range(1, 5))
        y = n1 / F.try_add(n1, 2 * n2)
        usual = [0.5, 1.0, 1.5]  # where a language has too few grams for the estimate
        found = [1 - 2 * y * F.try_divide(n2, n1), 2 - 3 * y * F.try_divide(n3, n2), 3 - 4 * y * F.try_divide(n4, n3)]
        safe = [F.when(F.least(n1, n2, n3, n4) > 0, F.greatest(F.lit(0.05), F.least(d, F.lit(i + 0.95)))).otherwise(F.lit(u)) for i, (d, u) in enumerate(zip(found, usual))]
        # One row a language.
        off = by_order[k].groupBy("lang").agg(*[number(i).alias(f"n{i}") for i in range(1, 5)]).select("lang", *[d.alias(f"d{i + 1}") for i, d in enumerate(safe)])
        rows = by_order[k].join(F.broadcast(off), "lang").withColumn("context", F.shiftright("gram", 8))
        cut_off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("off", F.least(cut_off, F.col("c").cast("double")))
        totals = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("gamma"))
        # Tables are sized by their compressed files; those of three bytes and more grow with the texts and are never shipped.
        large = (lambda df: df.hint("merge")) if k > 2 else (lambda df: df)
        joined = rows.select("lang", "gram", "context", "c", "off").join(large(totals), ["lang", "context"])
        own = (F.col("c") - F.col("off")) / F.col("total")
        if below is None:
            joined = joined.withColumn("p", own + F.col("gamma") / 256)
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            joined = (joined.withColumn("suffix", suffix).join(large(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("shorter"))), ["lang", "suffix"])
                      .withColumn("p", own + F.col("gamma") * F.col("shorter")))
        below = joined.select("lang", F.lit(k).alias("size"), "gram", "p")
        probabilities.append(below)
        weights.append(totals.select("lang", F.lit(k - 1).alias("size"), "context", "gamma"))
        below = probabilities[-1] = stored(below)
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(probabilities), stored(union(weights))


def shard_of(lang: str, last: np.ndarray, shards: int) -> np.ndarray:
    """Shard of the last bytes of a context."""
    mixed = (last.astype(np.uint64) + np.uint64(zlib.crc32(lang.encode()) << 16)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _dealt(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of every value of ``key``, in their order."""
    order = np.argsort(key, kind="stable")
    values, first = np.unique(key[order], return_index=True)
    yield from zip(values.tolist(), np.split(order, first[1:]))


def _model_blocks(shards: int, shared: int):
    """Rows (lang, kind, size, code, value) as one compressed block for each shard; those with too short a context go to all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            context = b.column("size").to_numpy() - (b.column("kind").to_numpy() == 0)
            code = b.column("code").to_numpy()
            last = np.where(b.column("kind").to_numpy() == 0, code >> 8, code) & ((1 << 8 * shared) - 1)
            shard = np.zeros(len(b), np.int64)
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                own = langs == lang
                shard[own] = shard_of(lang, last[own], shards)
            shard[context < shared] = -1
            for s, at in _dealt(shard):
                block = packed(b.take(pa.array(at)))
                wanted = list(range(shards)) if s < 0 else [s]
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int32()), pa.array([0] * len(wanted), pa.int32()), pa.array([-1] * len(wanted), pa.int32()),
                                                  pa.array([None] * len(wanted), pa.string()), pa.array([block] * len(wanted), pa.binary())], ["shard", "turn", "unit", "lang", "block"])

    return run


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch as one compressed block for each unit."""
    for b in batches:
        for unit, at in _dealt(b.column("unit").to_numpy()):
            yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([packed(b.drop_columns(["unit"]).take(pa.array(at)), PACKED)], pa.binary())], ["unit", "block"])


def _by_language(blocks: pa.ChunkedArray) -> tuple[list[pa.RecordBatch], dict[str, list[tuple[int, int]]], list[list[bytes]]]:
    """Batches of a unit, places (batch, row) of the texts of every language, and all texts as bytes."""
    batches = [rows for block in blocks for rows in unpacked(block)]
    places: dict[str, list[tuple[int, int]]] = {}
    for i, rows in enumerate(batches):
        for j, lang in enumerate(rows.column("lang").to_pylist()):
            if lang is not None:
                places.setdefault(lang, []).append((i, j))
    return batches, places, [[t or b"" for t in text_bytes(rows)] for rows in batches]


def _post(order: int, shards: int, shared: int):
    """Distinct n-grams of a unit, sorted, in one block for each language and shard."""

    def run(table: pa.Table) -> pa.Table:
        _, places, texts = _by_language(table["block"])
        rows = []
        for lang, own in places.items():
            found = [np.unique(code) for code, _, _ in coded([texts[i][j] for i, j in own], order)]
            if found:
                grams = np.unique(np.concatenate(found))
                for shard, at in _dealt(shard_of(lang, grams >> 8 & ((1 << 8 * shared) - 1), shards)):
                    rows.append((shard, lang, packed(pa.RecordBatch.from_arrays([pa.array(np.diff(grams[at], prepend=0))], ["step"]), PACKED)))
        unit = table["unit"][0].as_py()
        del texts
        let_go()
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "turn": pa.array([1] * len(rows), pa.int32()), "unit": pa.array([unit] * len(rows), pa.int32()),
                         "lang": pa.array([r[1] for r in rows], pa.string()), "block": pa.array([r[2] for r in rows], pa.binary())})

    return run


class Shard:
    """Grams and contexts of one shard by kind, language and size, as sorted arrays."""

    def __init__(self):
        self.parts: dict[tuple[int, str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.tables: dict[tuple[int, str, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, rows: pa.RecordBatch) -> None:
        kind, size, code, value = (rows.column(c).to_numpy() for c in ("kind", "size", "code", "value"))
        langs = np.array(rows.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            own = np.flatnonzero(langs == lang)
            for number, at in _dealt(size[own].astype(np.int64) * 2 + kind[own]):
                at = own[at]
                self.parts.setdefault((number % 2, lang, number // 2), []).append((code[at], value[at]))

    def _table(self, key: tuple[int, str, int]) -> tuple[np.ndarray, np.ndarray]:
        if key not in self.tables:
            code, value = (np.concatenate(x) for x in zip(*self.parts.pop(key, [(np.zeros(0, np.int64), np.zeros(0))])))
            order = np.argsort(code)
            self.tables[key] = code[order], value[order]
        return self.tables[key]

    def _find(self, key: tuple[int, str, int], code: np.ndarray) -> np.ndarray:
        """Value of every code, NaN where the shard has none."""
        codes, values = self._table(key)
        if not len(codes):
            return np.full(len(code), np.nan)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where(codes[at] == code, values[at], np.nan)

    def costs(self, lang: str, grams: np.ndarray, order: int) -> np.ndarray:
        """Nats of the last byte of every gram: that of the longest gram that is there, after the weights of the contexts that are there;
        NaN for a language without a model."""
        if not len(self._table((0, lang, 1))[0]):
            return np.full(len(grams), np.nan)
        paid, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(order, 0, -1):
            gram = grams[left] & ((1 << 8 * k) - 1)
            p = self._find((0, lang, k), gram)
            known = ~np.isnan(p)
            paid[left[known]] -= np.log(p[known])
            left, gram = left[~known], gram[~known]
            weight = self._find((1, lang, k - 1), gram >> 8)
            paid[left] -= np.log(np.where(np.isnan(weight), 1.0, weight))
        paid[left] += math.log(256)
        return paid


def _answer(order: int):
    """Costs of posted grams, block by block; the tables of a shard come before what is posted to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = -1, Shard()
        for b in batches:
            for s, turn, unit, lang, block in zip(b.column("shard").to_pylist(), b.column("turn").to_pylist(), b.column("unit").to_pylist(), b.column("lang").to_pylist(), b.column("block")):
                if s != shard:
                    shard, held = s, Shard()
                for rows in unpacked(block):
                    if turn == 0:
                        held.add(rows)
                    else:
                        costs = held.costs(lang, np.cumsum(rows.column("step").to_numpy()), order).astype(np.float32)
                        answer = packed(pa.RecordBatch.from_arrays([pa.array(costs)], ["cost"]), PACKED)
                        yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([s], pa.int32()), pa.array([lang], pa.string()), pa.array([answer], pa.binary())],
                                                         ["unit", "shard", "lang", "costs"])
        del held
        let_go()

    return run


def _sum_up(order: int, shards: int, shared: int, names: list[str]):
    """Nats of every text of a unit, from the costs of its distinct n-grams."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        batches, places, texts = _by_language(left["block"])
        nats = [np.full(len(t), np.nan) for t in texts]
        answers: dict[str, list[tuple[int, np.ndarray]]] = {}
        for lang, shard, block in zip(right["lang"].to_pylist(), right["shard"].to_pylist(), right["costs"]):
            answers.setdefault(lang, []).append((shard, np.concatenate([rows.column("cost").to_numpy() for rows in unpacked(block)])))
        for lang, own in places.items():
            total = np.zeros(len(own))
            slices_ = [(*np.unique(code, return_inverse=True), starts, numbers) for code, starts, numbers in coded([texts[i][j] for i, j in own], order)]
            if slices_:
                grams = np.unique(np.concatenate([s[0] for s in slices_]))
                cost = np.empty(len(grams))
                cost[np.argsort(shard_of(lang, grams >> 8 & ((1 << 8 * shared) - 1), shards), kind="stable")] = np.concatenate([c for _, c in sorted(answers[lang], key=lambda x: x[0])])
                for distinct, inverse, starts, numbers in slices_:
                    each = cost[np.searchsorted(grams, distinct)][inverse]
                    np.add.at(total, numbers, np.add.reduceat(each, starts))
            for (i, j), n in zip(own, total):
                nats[i][j] = n
        sizes = [len(t) for own in texts for t in own]
        columns = {c: pa.chunked_array([rows.column(c) for rows in batches]) for c in names}
        let_go()
        return pa.table({**columns, "n_bytes": pa.array(sizes, pa.int64()), "nats": pa.array(np.concatenate(nats), pa.float64(), from_pandas=True)})

    return run


def score(docs: DataFrame, p: DataFrame, gamma: DataFrame, order: int = ORDER, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """``docs`` (with columns lang and text) plus n_bytes and nats, the cost of the whole text; nats is null where the language has no model,
    and zero for null and empty texts of a language that has one."""
    names = [c for c in docs.columns if c != "text"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, -(-int(size) // unit_bytes))
    shards, shared = min(units, SHARDS), min(SHARED, order - 1)
    unit = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(units)).cast("int")
    blocks = docs.select(*names, "text", unit.alias("unit")).mapInArrow(_text_blocks, "unit int, block binary").repartition("unit")
    row = "shard int, turn int, unit int, lang string, block binary"
    posted = blocks.groupBy("unit").applyInArrow(_post(order, shards, shared), row)
    model = p.select("lang", F.lit(0).alias("kind"), "size", F.col("gram").alias("code"), F.col("p").alias("value")).unionByName(
        gamma.select("lang", F.lit(1).alias("kind"), "size", F.col("context").alias("code"), F.col("gamma").alias("value")))
    met = model.mapInArrow(_model_blocks(shards, shared), row).unionByName(posted).repartition("shard").sortWithinPartitions("shard", "turn")
    answered = met.mapInArrow(_answer(order), "unit int, shard int, lang string, costs binary")
    fields = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in names], T.StructField("n_bytes", T.LongType()), T.StructField("nats", T.DoubleType())])
    return blocks.groupBy("unit").cogroup(answered.groupBy("unit")).applyInArrow(_sum_up(order, shards, shared, names), fields)


def judge(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN,
          prior: int = PRIOR_BYTES) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, rate, threshold, keep) of every row of ``docs``.

    ``trusted`` is (lang, text).  Perplexity is per byte.  ``threshold`` bounds the smoothed rate (nats a byte): the language's quantile over
    its held-out trusted texts plus the margin.  A text over it goes, one at it stays.  A null language is judged like any other value; a
    language without trusted texts has no model, and its texts stay with null perplexity.  A null or empty text has no rate and stays.
    Repeated rows are judged each, repeated trusted texts count as often as they occur; an empty table gives no rows; other columns are not
    read.
    """
    named = stored(trusted.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").where("text is not null"))
    fold = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT))
    p, gamma = tables(stored(count_grams(named.where(fold != 0), order, raw)), order)
    read = docs.select("doc_id", F.col("lang").alias("_lang"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    checked = stored(score(named.where(fold == 0), p, gamma, order).where("n_bytes > 0 and nats is not null"))
    scored = score(read, p, gamma, order)
    means = checked.groupBy("lang").agg((F.sum("nats") / F.sum("n_bytes")).alias("mean"))
    smooth = (F.col("nats") + prior * F.col("mean")) / (F.col("n_bytes") + prior)
    bounds = checked.join(means, "lang").groupBy("lang", "mean").agg(F.percentile_approx(smooth, quantile, 10000).alias("q"))
    bounds = cut(bounds.select("lang", "mean", (F.col("q") + margin).alias("threshold")))
    # One row a language.
    judged = scored.join(F.broadcast(bounds), "lang", "left")
    rate = F.when(F.col("n_bytes") > 0, smooth)
    return judged.select("doc_id", F.col("_lang").alias("lang"), "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(F.col("nats") / F.col("n_bytes"))).alias("perplexity"),
                         rate.alias("rate"), "threshold", F.coalesce(rate <= F.col("threshold"), F.lit(True)).alias("keep"))
