"""Embedding near-duplicates with a pivot-permutation index.

A vector is described by its nearest reference points in order.  It is listed under each of them; two vectors are candidates if their
prefixes share at least ``shared`` pivots, and a pair is looked at in the list of the first pivot that both hold, nowhere else.  Equal
vectors are one entry with a weight.  A list is cut into parts, and every two parts of it are one group of bounded size, whose candidates
are verified by exact cosines; a group gives link counts and a spanning star, never its pairs.

The reference points are the vectors with the lowest hashes, ``4 * sqrt(n)`` of them within bounds; every vector is indexed.

Dense regions are exact.  Where many reference points lie inside one region, the nearest eight of two of its vectors depend on noise, so
prefixes decide nothing there.  A net of reference points is chosen, no two of which have a cosine of ``HOME`` or more.  A vector within
``HOME`` of its nearest net point has that point as its home and is in no prefix list.  Whatever links with it lies within the sum of both
angles of the home, so every vector is listed under each net point within that angle.  A pair of which one vector at least has a home is
verified, without a look at prefixes, in the list of the lowest home of the two; prefixes decide between vectors without a home only.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import cut
from studyloom.llm.graph import components
from studyloom.llm.simhash import _union

THRESHOLD = 0.9
PREFIX = 8
SHARED = 2
MIN_PIVOTS, MAX_PIVOTS = 32, 4096
# Cosine to the nearest net point from which on a vector belongs to its region.
HOME = 0.85
NO_HOME = 1 << 30
# Vectors of one list in a part; a group holds two parts.
PART = 512


def has_direction(x: F.Column) -> F.Column:
    """True for a vector that is not null, not zero, and has finite components only."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def pivot_count(n: int) -> int:
    return max(1, min(n, MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(4 * math.sqrt(n)))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scale = np.abs(flat).max(1, keepdims=True)  # first by the largest component, so that no square overflows or vanishes
    flat = flat / scale
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def net_points(pivots: np.ndarray, home: float = HOME) -> np.ndarray:
    """Numbers of pivots, in order, of which no two have a cosine of ``home`` or more; every pivot is that near to one of them."""
    open_, chosen = np.ones(len(pivots), bool), []
    for i in range(len(pivots)):
        if open_[i]:
            chosen.append(i)
            open_ &= pivots @ pivots[i] < home
    return np.array(chosen, np.int64)


def _describe(pivots: np.ndarray, prefix: int, threshold: float):
    """Prefix, home and lists of every vector; lists of net points are numbered -1 - point."""
    net = net_points(pivots)
    within = min(math.pi, math.acos(HOME) + math.acos(max(-1.0, min(1.0, threshold))) + 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 4096):
                b = whole.slice(a, 4096)
                x = _matrix(b.column("embedding"), pivots.shape[1])
                near = x @ pivots.T
                take = min(prefix, len(pivots))
                top = np.argpartition(-near, take - 1, axis=1)[:, :take]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
                around = near[:, net]
                best = around.argmax(1)
                home = np.where(np.take_along_axis(around, best[:, None], 1)[:, 0] >= HOME, net[best], NO_HOME)
                met = around >= math.cos(within)
                lists = [[*(-1 - net[m]).tolist(), *(t.tolist() if h == NO_HOME else ())] for m, t, h in zip(met, top, home)]
                prefixes = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * take, pa.int32()), pa.array(top.ravel().astype("i4")))
                yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("weight"), b.column("embedding"), prefixes, pa.array(home.astype("i4")),
                                                  pa.array(lists, pa.list_(pa.int32()))], ["entry", "weight", "embedding", "prefix", "home", "lists"])

    return run


def _first_shared(a: np.ndarray, b: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Pairs that share at least ``shared`` pivots of which ``pivot`` is the lowest; rows are prefixes."""
    count = np.zeros((len(a), len(b)), np.int8)
    lower = np.zeros((len(a), len(b)), bool)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            same = a[:, i][:, None] == b[:, j][None]
            count += same
            lower |= same & (a[:, i] < pivot)[:, None]
    return (count >= shared) & ~lower


def _verify(threshold: float, shared: int):
    def run(table: pa.Table) -> pa.Table:
        entry, weight, own, home = (table[c].to_numpy() for c in ("entry", "weight", "own", "home"))
        pivot, one, two = (table[c][0].as_py() for c in ("pivot", "one", "two"))
        column = table["embedding"].combine_chunks()
        x = _matrix(column, len(column[0]))
        prefix = table["prefix"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        if len(left) and len(right):
            if pivot < 0:
                near = np.minimum.outer(home[left], home[right]) == -1 - pivot
            else:
                near = _first_shared(prefix[left], prefix[right], pivot, shared)
            near &= x[left] @ x[right].T >= threshold
            if one == two:
                np.fill_diagonal(near, False)
            links[left] += near @ weight[right]
            if one != two:
                links[right] += near.T @ weight[left]
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
            while len(i):  # one link a row and round settles most of a dense group
                _, pick = np.unique(i, return_index=True)
                _union(root, zip(i[pick].tolist(), j[pick].tolist()))
                while not np.array_equal(root, up := root[root]):
                    root = up
                open_ = root[i] != root[j]
                i, j = i[open_], j[open_]
        told = np.flatnonzero(links)
        return pa.table({"entry": pa.array(entry[told]), "links": pa.array(links[told]), "to": pa.array(entry[root[told]])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths.  Equal
    vectors, repeated rows among them, link with each other.  A null id never becomes a component unless it is alone; ``kept`` compares
    ids null-safe.  Labels and other columns are not read.
    """
    rows = cut(vectors.select("vec_id", "embedding"))
    entries = cut(rows.where(has_direction(F.col("embedding"))).groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
                  .select("*", F.xxhash64("embedding").alias("entry")))
    if entries.select("entry").distinct().count() != entries.count():
        raise RuntimeError("two vectors share a hash")
    counted = None
    for r in entries.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").toLocalIterator():
        same = entries.where(F.size("embedding") == r["dim"])
        chosen = same.orderBy("entry").limit(pivot_count(r["n"])).select("embedding").toPandas()
        pivots = np.stack([np.asarray(v, np.float64) for v in chosen["embedding"]])
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
        kind = entries.schema["embedding"].dataType.simpleString()
        described = same.mapInArrow(_describe(pivots, prefix, threshold), f"entry long, weight long, embedding {kind}, prefix array<int>, home int, lists array<int>")
        described = cut(described)
        posted = described.select("*", F.explode("lists").alias("pivot")).drop("lists")
        sizes = posted.groupBy("pivot").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
        dealt = posted.join(sizes, "pivot").withColumn("own", F.pmod(F.xxhash64("entry", "pivot"), F.col("parts")).cast("int"))
        met = (dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
               .select("entry", "weight", "embedding", "prefix", "home", "pivot", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")))
        found = met.groupBy("pivot", "one", "two").applyInArrow(_verify(threshold, min(shared, len(pivots))), "entry long, links long, to long")
        counted = found if counted is None else counted.union(found)
    if counted is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counted = cut(counted)
    linked = components(counted.select(F.col("entry").alias("u"), F.col("to").alias("v")))
    total = counted.groupBy("entry").agg(F.sum("links").alias("links"))
    rooted = (entries.join(linked.withColumnRenamed("node", "entry"), "entry", "left").join(total, "entry", "left")
              .select("entry", "weight", "first", F.coalesce("component", "entry").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("entry", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    keyed = rows.select("vec_id", F.when(has_direction(F.col("embedding")), F.xxhash64("embedding")).alias("entry"))
    out = keyed.join(named, "entry", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

