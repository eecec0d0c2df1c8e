"""Part codes by anchors trees against the plain definition."""

import hashlib

import numpy as np
import pytest

from studyloom.llm import anchors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _label string"


def plain(rows, rounds=anchors.ROUNDS):
    """{vec_id: [(code, error, label)]} and digest, entry by entry."""
    kept = []
    for vec_id, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(4096 * float(np.float32(x)))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    points = np.array([v for _, v, _ in kept], dtype=object).reshape(len(kept), 8, width)
    books = [[list(points[i][p]) for i in range(min(16, len(kept)))] for p in range(8)]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            own = [[] for _ in books[p]]
            for row in points:
                own[nearest(row[p], books[p])[1]].append(row[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if m else e for e, m in zip(books[p], own)]
    out = []
    for (vec_id, _, label), row in zip(kept, points):
        found = [nearest(row[p], books[p]) for p in range(8)]
        out.append((vec_id, "".join(f"{k:02x}" for _, k in found), int(sum(d for d, _ in found)), label))
    digest = hashlib.sha256(",".join(str(int(x)) for book in books for e in book for x in e).encode()).hexdigest()
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return sorted([(i is None, i or 0, c, e, sums[label], digest) for i, c, e, label in out])


def coded(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA).repartition(3)
    found = anchors.with_label_error(anchors.compress(df, **options)).collect()
    return sorted([(r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found])


def random_rows(n, width, seed=1, clusters=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.2, (n, width))
    if clusters:
        v = rng.normal(0, 1, (clusters, width))[rng.integers(clusters, size=n)] + v / 40
    return [(int(i), v[i].astype(np.float32).tolist(), int(rng.integers(4))) for i in range(n)]


def test_codes_equal_the_definition(spark):
    rows = random_rows(300, 24)
    assert coded(spark, rows, block=64) == plain(rows)


def test_clusters_copies_ties_and_odd_rows(spark):
    rows = random_rows(250, 16, 2, clusters=5)
    rows += [(1000 + i, rows[0][1], None) for i in range(90)]  # copies hold a good part of the rows
    rows += [(7, rows[3][1], 1), (None, rows[9][1], None), (2001, None, 1)]
    rows += [(2003, [float("nan")] * 16, 0), (2004, [None] + [0.5] * 15, 0), (2005, [float("inf")] * 16, 0), (2006, [0.0] * 16, 3), (2007, [-1e-9] * 16, 3)]
    assert coded(spark, rows, block=50) == plain(rows)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = random_rows(5, 8)
    assert coded(spark, rows) == plain(rows)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


def test_vectors_that_do_not_fit(spark):
    for rows in ([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 9, 1)], [(1, [], 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            coded(spark, rows)


def test_balls_are_owned_without_reading_their_points():
    """On clustered parts most points are never compared; on every tree sums, counts and nearest entries are those of all pairs."""
    rng = np.random.default_rng(4)
    for values in (np.repeat(rng.integers(-4000, 4000, (12, 8)), 250, axis=0) + rng.integers(-60, 60, (3000, 8)), rng.integers(-900, 900, (2000, 6)), np.zeros((100, 3), np.int64)):
        tree = anchors.build(values)
        entries = values[:: len(values) // 16][:16]
        owner = ((values[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        sums, counts, read = anchors.walk(tree, entries)
        assert counts.tolist() == np.bincount(owner, minlength=len(entries)).tolist()
        assert all((values[owner == k].sum(axis=0) == sums[k]).all() for k in range(len(entries)))
        found, error = anchors.assign(anchors._read(next(iter(anchors.pa.array([anchors._written(tree)])))), entries)
        assert (found == owner).all() and (error == ((values - entries[owner]) ** 2).sum(axis=1)).all()
        assert (tree.radius[-1] + 1e-6 >= np.sqrt(((values - tree.centre[-1]) ** 2).sum(axis=1))).all()
        if len(values) == 3000:
            assert read < 1500
