"""Ranking and ordered folds that do not put one key's rows into one task.

A plain ``row_number()`` over a key sends the whole key to a single task.  ``numbered`` cuts each
key into buckets that follow the wanted order, ranks inside the buckets and adds the size of the
earlier buckets, so that a key holding a third of the table is still spread over many tasks.

A fold whose every step needs the rounded result of the one before is cut into segments.  What a segment makes of
each possible state is a map; maps are composed in a tree, which gives the state at the start of every
segment, and then all segments are folded side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from studyloom.session import cut


def unfold(df: DataFrame, keep: Sequence[str | Column], items: Column, pos: str, item: str) -> DataFrame:
    """Elements of an array as rows with their position.

    The outer form keeps the optimizer from adding a size filter, which would evaluate the array twice.
    """
    return (df.select(*keep, F.posexplode_outer(items).alias(pos, item)).filter(F.col(pos).isNotNull()))


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that ``df`` can be grouped together with something made of the same rows."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows per key.  Spark prunes to k rows per key before the shuffle (WindowGroupLimit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def numbered(df: DataFrame, keys: Sequence[str], bucket: Sequence[Column], order: Sequence[Column],
             out: str = "rn") -> DataFrame:
    """1-based rank per key in ``order``.

    ``bucket`` are expressions that never decrease along ``order`` (nulls are not allowed); the
    per-bucket counts are aggregated before the shuffle, and only they are windowed per key.
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    marked = df.select("*", *[b.alias(n) for b, n in zip(bucket, names)])
    before = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    sizes = (marked.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
             .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                     *[F.col(n).alias(f"_o{n}") for n in names],
                     F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on += [F.col(n) == F.col(f"_o{n}") for n in names]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    inside = W.partitionBy(*keys, *names).orderBy(*order)
    drop = names + [f"_o{n}" for n in names] + [f"_k{i}" for i in range(len(keys))] + ["_before"]
    return (marked.join(sizes, cond)
            .withColumn(out, (F.row_number().over(inside) + F.col("_before")).cast("long"))
            .drop(*drop))


# Rows of a segment of a key; maps that are composed at once.
SEGMENT, FAN = 4096, 64


def segments(rows: DataFrame, keys: Sequence[str], bucket: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """``rows`` with their number per key (``_n`` from 1) and the segment of their key that they are in (``_segment`` from 0).

    A key of any size is many segments; ``bucket`` is as in ``numbered``.
    """
    return numbered(rows, keys, bucket, order, "_n").withColumn("_segment", F.expr(f"(_n - 1) div {SEGMENT}"))


def full_segments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of all segments but the last of their key; most keys have none."""
    last = rows.groupBy(*keys).agg(F.max("_segment").alias("_last")).where("_last > 0")
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    last = last.select("_last", *names)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(last, [*same, F.col("_segment") < F.col("_last")]).select(rows.columns)


def _scan(keys: Sequence[str], index: Callable, start: int, rows: pa.Table) -> pa.Table:
    """State after every segment of the group, which is where the next segment starts."""
    rows = rows.sort_by("_segment")
    states = []
    for table in rows["_map"]:
        start = int(np.frombuffer(zlib.decompress(table.as_py()), np.int64)[index(np.array([start]))[0]])
        states.append(start)
    return pa.table({**{k: rows[k] for k in keys}, "_segment": pc.add(rows["_segment"], 1), "_start": pa.array(states, pa.int64())})


def segment_starts(maps: DataFrame, keys: Sequence[str], index: Callable[[np.ndarray], np.ndarray], initial: int) -> DataFrame:
    """(keys, _segment, _start): the state at the start of every segment but the first of a key.

    ``maps`` is (keys, _segment, _map): what a segment makes of every state, as ``packed_map`` writes it, for all segments but the last.
    ``index`` gives the place of a state in a map.  Maps are composed FAN at a time in a tree, so the segments of one key are many tasks.
    """
    keys = list(keys)
    rows = cut(maps)
    named = [rows.schema[k] for k in keys]
    fields = T.StructType([*named, T.StructField("_segment", T.LongType()), T.StructField("_start", T.LongType())])
    if (rows.agg(F.max("_segment")).first()[0] or 0) < FAN:
        return rows.groupBy(*keys).applyInArrow(lambda table: _scan(keys, index, initial, table), fields)
    group = F.expr(f"_segment div {FAN}")

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("_segment")
        total = None
        for one in table["_map"]:
            step = np.frombuffer(zlib.decompress(one.as_py()), np.int64)
            total = step if total is None else step[index(total)]
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "_segment": table["_group"].slice(0, 1), "_map": pa.array([packed_map(total)], pa.binary())})

    grouped = rows.withColumn("_group", group)
    higher = grouped.groupBy(*keys, "_group").applyInArrow(composed, T.StructType([*named, T.StructField("_segment", T.LongType()), T.StructField("_map", T.BinaryType())]))
    starts = fresh(segment_starts(higher, keys, index, initial).withColumnRenamed("_segment", "_group"))

    def inside(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scan(keys, index, right["_start"][0].as_py() if right.num_rows else initial, left)

    return grouped.groupBy(*keys, "_group").cogroup(starts.groupBy(*keys, "_group")).applyInArrow(inside, fields)


def started(rows: DataFrame, starts: DataFrame, keys: Sequence[str], **columns: int) -> DataFrame:
    """``rows`` with the columns of ``starts`` (keys, _segment, ...) of their segment, or the given values in the first one of a key."""
    names = [*keys, "_segment"]
    known = starts.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(names)], *[F.col(c).alias(f"_at_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(names)]
    return rows.join(known, same, "left").select(*rows.columns, *[F.coalesce(f"_at_{c}", F.lit(v)).cast("long").alias(c) for c, v in columns.items()])


def packed_map(states: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(states, np.int64).tobytes(), 1)


def fold_segments(rows: DataFrame, keys: Sequence[str], begin: Callable, step: Callable, emit: Callable, schema: T.StructType) -> DataFrame:
    """Folds all segments side by side: a step works on the next row of every segment of an Arrow batch at once.

    ``begin(batch, first)`` gives the state of the segments whose first rows are at ``first``, a list of arrays; ``step(state, columns,
    at)`` the state after the rows at ``at``; ``emit(batch, before, after)`` the output for the states around each row.  Rows need
    ``_n`` and ``_segment``.
    """
    ordered = rows.repartition(*keys, "_segment").sortWithinPartitions(*keys, "_segment", "_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for b in batches:
            if not len(b):
                continue
            first = np.flatnonzero((b.column("_n").to_numpy() - 1) % SEGMENT == 0)
            goes_on = not len(first) or first[0] != 0
            if goes_on:
                first = np.concatenate([[0], first])
            size = np.diff(np.append(first, len(b)))
            state = begin(b, first)
            if goes_on:
                for mine, old in zip(state, carried):
                    mine[0] = old
            before = [np.empty(len(b), s.dtype) for s in state]
            after = [np.empty(len(b), s.dtype) for s in state]
            order = np.argsort(-size, kind="stable")
            state, first, size = [s[order] for s in state], first[order], size[order]
            active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # segments of more than t rows
            for t in range(size[0]):
                n = active[t]
                at = first[:n] + t
                for kept, s in zip(before, state):
                    kept[at] = s[:n]
                for k, s in enumerate(step([s[:n] for s in state], b, at)):
                    after[k][at] = state[k][:n] = s
            carried = [s[np.flatnonzero(order == len(order) - 1)[0]] for s in state]
            yield emit(b, before, after)

    return ordered.mapInArrow(run, schema)
