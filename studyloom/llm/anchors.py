"""Vector code compression: k-means codebooks for the parts of a vector, fitted through metric trees of the anchors hierarchy.

Vectors are cut into equal parts.  Every block of vectors gets one tree a part, built once: anchors are placed one after the other at the
point furthest from its anchor, and steal the points that are closer to them (points nearer to their anchor than half the distance of the
two anchors cannot be stolen and are not compared).  The anchors' balls are the middle of the tree: merged pair by pair they give its top,
divided anew by the same procedure they give its lower levels.  A ball caches count and sum of its points.

A round of k-means walks each tree from the top with the list of entries that may own points of the ball.  An entry leaves the list where
another one is closer to every point of the ball; children inherit the list.  A ball left with one entry is wholly owned: its cached sum
and count go to that entry and its points are never read.  Only sums and counts, one row an entry and component, leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Vectors whose parts share a tree.
BLOCK = 4096
# Points of a ball that is not divided further.
LEAF = 24
# Scaled components up to this size give exact sums of squares in 64 bits.
LARGEST = 1 << 26


@dataclass
class Tree:
    """Balls from the top down; a leaf owns ``points[first:last]``, every ball a stretch of points in tree order."""

    points: np.ndarray  # [n, d] in tree order
    order: np.ndarray  # place of every point in its block
    centre: np.ndarray  # [balls, d]
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray  # balls; -1 at a leaf
    right: np.ndarray
    total: np.ndarray  # [balls, d] sum of the points


def anchors(points: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner of every point, distance to it) for up to ``wanted`` anchors; the first is the first point, equal points share an anchor."""
    pivots = points[:1]
    owner = np.zeros(len(points), np.int64)
    far = np.sqrt(((points - pivots[0]) ** 2).sum(axis=1))
    while len(pivots) < wanted:
        at = int(far.argmax())
        if far[at] == 0:
            break
        new = points[at]
        reach = np.sqrt(((pivots - new) ** 2).sum(axis=1)) / 2
        open_ = np.flatnonzero(far > reach[owner])
        gap = np.sqrt(((points[open_] - new) ** 2).sum(axis=1))
        stolen = gap < far[open_]
        owner[open_[stolen]], far[open_[stolen]] = len(pivots), gap[stolen]
        pivots = np.concatenate([pivots, new[None]])
    return owner, far


def build(values: np.ndarray, leaf: int = LEAF) -> Tree:
    """Tree over integer points [n, d], n > 0."""
    points = values.astype(np.float64)
    order: list[np.ndarray] = []
    balls: list[list] = []  # centre, radius, first, last, left, right
    size = 0

    def ball(members: np.ndarray, first: int, left: int = -1, right: int = -1) -> int:
        own = points[members]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())) if own.shape[1] else 0.0
        balls.append([centre, radius, first, first + len(members), left, right])
        return len(balls) - 1

    def divide(members: np.ndarray) -> tuple[int, np.ndarray]:
        """Ball over the members, and the members in tree order; children come before their parent."""
        nonlocal size
        if len(members) > leaf:
            owner, _ = anchors(points[members], int(np.sqrt(len(members))))
            groups = [members[owner == a] for a in range(int(owner.max()) + 1)]
        if len(members) <= leaf or len(groups) == 1:  # small, or nothing but equal points
            at, size = ball(members, size), size + len(members)
            order.append(members)
            return at, members
        return merge(groups)

    def merge(groups: list[np.ndarray]) -> tuple[int, np.ndarray]:
        """Pairs of balls that make the smallest ball are joined until one is left; then their points are laid out along the tree."""
        centre = np.array([points[g].mean(axis=0) for g in groups])
        radius = np.array([np.sqrt(((points[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centre)])
        weight = np.array([len(g) for g in groups], float)
        shape: list = list(range(len(groups)))
        cost = (np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2)) + radius[:, None] + radius[None]) / 2
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(groups) - 1):
            a, b = divmod(int(cost.argmin()), len(cost))
            radius[a] = max(cost[a, b], radius[a], radius[b])
            centre[a] = (centre[a] * weight[a] + centre[b] * weight[b]) / (weight[a] + weight[b])
            weight[a] += weight[b]
            shape[a] = (shape[a], shape[b])
            cost[b, :] = cost[:, b] = np.inf
            alive = np.flatnonzero(np.isfinite(cost[a]))
            cost[a, alive] = cost[alive, a] = (np.sqrt(((centre[alive] - centre[a]) ** 2).sum(axis=1)) + radius[alive] + radius[a]) / 2
        # Down the shape without recursion, as a lopsided one may be deep: children are laid out before their parent.
        done: list[tuple[int, np.ndarray]] = []
        todo: list[tuple] = [(shape[a], False)]
        while todo:
            node, ready = todo.pop()
            if not isinstance(node, tuple):
                done.append(divide(groups[node]))
            elif ready:
                (r, right), (l, left) = done.pop(), done.pop()
                members = np.concatenate([left, right])
                done.append((ball(members, balls[l][2], l, r), members))
            else:
                todo += [(node, True), (node[1], False), (node[0], False)]
        return done[0]

    divide(np.arange(len(points)))
    laid = np.concatenate(order)
    sums = np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values[laid].astype(np.int64), axis=0)])
    first, last = (np.array([b[k] for b in balls], np.int64) for k in (2, 3))
    return Tree(values[laid], laid, np.array([b[0] for b in balls]), np.array([b[1] for b in balls]), first, last,
                np.array([b[4] for b in balls]), np.array([b[5] for b in balls]), sums[last] - sums[first])


def _alive(tree: Tree, at: np.ndarray, listed: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries of the inherited lists that may still own a point of the balls ``at``.

    An entry goes if the likeliest one is closer to every point of the ball, by more than what rounding can be.
    """
    real = entries.astype(np.float64)
    near = ((tree.centre[at][:, None] - real[None]) ** 2).sum(axis=2)
    near[~listed] = np.inf
    best = near.argmin(axis=1)
    apart = np.sqrt(((real[best][:, None] - real[None]) ** 2).sum(axis=2))
    least = near[np.arange(len(at)), best][:, None]
    reach = 2 * tree.radius[at][:, None] * apart
    with np.errstate(invalid="ignore"):
        beaten = near - least > reach + 1e-6 * (1 + least + reach)
    return listed & ~beaten


def walk(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(sums [entries, d], counts) of the points by nearest entry, ties to the lower one, and the number of points that were compared."""
    sums, counts, read = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64), 0
    at, listed = np.array([len(tree.first) - 1]), np.ones((1, len(entries)), bool)
    while len(at):
        listed = _alive(tree, at, listed, entries)
        whole = listed.sum(axis=1) == 1
        owner = listed[whole].argmax(axis=1)
        np.add.at(sums, owner, tree.total[at[whole]])
        np.add.at(counts, owner, tree.last[at[whole]] - tree.first[at[whole]])
        leaf = ~whole & (tree.left[at] < 0)
        if leaf.any():
            rows, asked = _points(tree, at[leaf], listed[leaf])
            nearest, _ = _nearest(tree.points[rows], entries, asked)
            np.add.at(sums, nearest, tree.points[rows].astype(np.int64))
            np.add.at(counts, nearest, 1)
            read += len(rows)
        inner = ~whole & ~leaf
        at, listed = np.concatenate([tree.left[at[inner]], tree.right[at[inner]]]), np.concatenate([listed[inner], listed[inner]])
    return sums, counts, read


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of every point, in the order of the block; a wholly owned ball needs no comparison of entries."""
    owner, error = np.zeros(len(tree.order), np.int64), np.zeros(len(tree.order), np.int64)
    at, listed = np.array([len(tree.first) - 1]), np.ones((1, len(entries)), bool)
    while len(at):
        listed = _alive(tree, at, listed, entries)
        end = (listed.sum(axis=1) == 1) | (tree.left[at] < 0)
        if end.any():
            rows, asked = _points(tree, at[end], listed[end])
            nearest, gap = _nearest(tree.points[rows], entries, asked)
            owner[tree.order[rows]], error[tree.order[rows]] = nearest, gap
        at, listed = np.concatenate([tree.left[at[~end]], tree.right[at[~end]]]), np.concatenate([listed[~end], listed[~end]])
    return owner, error


def _points(tree: Tree, at: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all points of the balls, and the entries to compare with each."""
    size = tree.last[at] - tree.first[at]
    rows = np.repeat(tree.first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return rows, np.repeat(listed, size, axis=0)


def _nearest(points: np.ndarray, entries: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.full(asked.shape, np.iinfo(np.int64).max)
    row, entry = np.nonzero(asked)
    gap[row, entry] = ((points[row].astype(np.int64) - entries[entry]) ** 2).sum(axis=1)
    nearest = gap.argmin(axis=1)
    return nearest, gap[np.arange(len(gap)), nearest]


# --------------------------------------------------------------------------------------------- trees as rows
def _written(tree: Tree) -> bytes:
    small = np.int16 if tree.points.size == 0 or np.abs(tree.points).max() < 1 << 15 else np.int32
    columns = [tree.points.astype(small).ravel(), tree.order.astype(np.int32), tree.centre.ravel(), tree.radius, tree.first.astype(np.int32),
               tree.last.astype(np.int32), tree.left.astype(np.int32), tree.right.astype(np.int32), tree.total.ravel()]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array([c], pa.list_(pa.from_numpy_dtype(c.dtype))) for c in columns], [str(i) for i in range(len(columns))])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(block) -> Tree:
    batch = next(iter(pa.ipc.open_stream(block.as_buffer())))
    points, order, centre, radius, first, last, left, right, total = (c.values.to_numpy() for c in batch.columns)
    width = len(points) // len(order)
    return Tree(points.reshape(-1, width), order.astype(np.int64), centre.reshape(-1, width), radius, first.astype(np.int64), last.astype(np.int64),
                left.astype(np.int64), right.astype(np.int64), total.reshape(-1, width))


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) with integer components; rows without a vector or with a null or non-finite component are gone."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    real = F.col("embedding").cast("array<double>")
    fine = F.forall(real, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.col("embedding").isNotNull() & fine).select("vec_id", label.alias("label"), F.transform(real, lambda x: F.floor(x * scale)).alias("v"))


def blocks(rows: DataFrame, parts: int = PARTS, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(ids, labels, trees) of up to ``block`` vectors each, one tree a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), block):
                piece = b.slice(a, block)
                values = pc.list_flatten(piece.column("v")).to_numpy().reshape(len(piece), -1)
                trees = [_written(build(part, leaf)) for part in np.split(values, parts, axis=1)]
                yield pa.RecordBatch.from_arrays([*[pa.ListArray.from_arrays([0, len(piece)], piece.column(c)) for c in ("vec_id", "label")], pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    kinds = [T.ArrayType(rows.schema[c].dataType) for c in ("vec_id", "label")]
    schema = T.StructType([T.StructField("ids", kinds[0]), T.StructField("labels", kinds[1]), T.StructField("trees", T.ArrayType(T.BinaryType()))])
    return rows.mapInArrow(run, schema)


def moved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks [parts, entries, width] after one round; one row an entry and component comes back, however many vectors there are."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width + 1), object), np.zeros((parts, entries), np.int64)
        for b in batches:
            for row in b.column("trees"):
                for p, tree in enumerate(row.values):
                    s, n, _ = walk(_read(tree), books[p])
                    sums[p, :, :width] += s
                    counts[p] += n
        sums[:, :, width] = counts
        met = np.flatnonzero(np.repeat(counts.ravel() > 0, width + 1))
        values = pa.array([Decimal(int(x)) for x in sums.ravel()[met]], pa.decimal128(38))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), values], ["place", "value"])

    found = trees.select("trees").mapInArrow(run, "place long, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(parts * entries * (width + 1), object)
    for r in found:
        total[r["place"]] = int(r["value"])
    total = total.reshape(parts, entries, width + 1)
    new = books.copy()
    for p, e in zip(*np.nonzero(total[:, :, width])):
        new[p, e] = [int(x) // int(total[p, e, width]) for x in total[p, e, :width]]
    return new


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every vector without null or non-finite components.

    Components become floor(``scale`` * x).  Codebooks start as the parts of the smallest ids; of equal ids the vector that is smaller by
    components comes first, null ids come last.  Fewer vectors than ``entries`` give smaller codebooks.  Repeated rows are coded each; a null
    label is a label; an empty table gives no rows; columns other than vec_id, embedding and label are not read.  Vectors of different
    lengths, lengths that ``parts`` does not divide, vectors without components and scaled components beyond LARGEST raise ValueError.  Nothing but the sums, counts and
    components of the codebooks passes the driver.
    """
    rows = scaled(vectors, scale)
    about = rows.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("z"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))).alias("far")).first()
    fields = [rows.schema["vec_id"], rows.schema["label"], *[T.StructField(n, k) for n, k in (("code", T.StringType()), ("error", T.LongType()), ("codebooks_sha256", T.StringType()))]]
    if about["a"] is None:
        return vectors.sparkSession.createDataFrame([], T.StructType(fields))
    if about["a"] != about["z"] or not about["a"] or about["a"] % parts or about["far"] > LARGEST:
        raise ValueError(f"vectors of {about['a']} to {about['z']} components up to {about['far']} do not fit {parts} parts of up to {LARGEST}")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    trees = stored(blocks(rows, parts, block))
    for _ in range(rounds):
        books = moved(trees, books)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(books.shape[1])])
        for b in batches:
            for ids, labels, row in zip(b.column("ids"), b.column("labels"), b.column("trees")):
                coded = [assign(_read(tree), books[p]) for p, tree in enumerate(row.values)]
                code, error = np.array([digits[o] for o, _ in coded]).T, sum(e for _, e in coded)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(["".join(c) for c in code.tolist()]), pa.array(error, pa.int64()),
                                                  pa.array([digest] * len(error))], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return trees.mapInArrow(run, T.StructType(fields))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` plus label_error, the sum of the errors of all vectors with the same label, nulls together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
