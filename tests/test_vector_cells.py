"""Exact vector search over stored cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.operators import retrieval as rt
from studyloom.sources import vector_cells as vc

CHUNKS = "id long, document_id long, is_active boolean, content string"
QUESTIONS = "question_id long, owner_id long, subject_id long, document_ids array<long>, vector array<float>"


def tables(spark, vectors):
    """Vector i is chunk i of document i % 10; owner 1 has documents 0 to 6."""
    emb = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "chunk_id long, embedding array<float>").repartition(3)
    chunks = spark.createDataFrame([(i, i % 10, i % 13 != 12, "t") for i in range(len(vectors))], CHUNKS)
    docs = spark.createDataFrame([(d, 1 if d < 7 else 2, d % 3, "READY" if d != 5 else "FAILED") for d in range(10)], "id long, owner_id long, subject_id long, status string")
    return emb, chunks, docs


def brute(vectors, asked, k=5):
    out = []
    for qid, owner, subject, listed, q in asked:
        scores = []
        for i, v in enumerate(vectors):
            d = i % 10
            if v is None or q is None or len(v) != len(q) or not any(v) or not any(q) or not np.isfinite(v).all() or i % 13 == 12 or d == 5 or (1 if d < 7 else 2) != owner:
                continue
            if d in listed if listed else subject is None or d % 3 == subject:
                a, b = np.float32(v).astype(float), np.float32(q).astype(float)
                scores.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), i))
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(df):
    return sorted((r.question_id, r.rank_order, r.chunk_id, round(r.score, 9)) for r in df.collect())


def clustered(n, seed, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(centres[rng.integers(12)] + rng.normal(size=width) / 20).tolist() for _ in range(n)]


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_equals_all_cosines(spark, monkeypatch, kind):
    """Owners of many cells, cells of many parts, questions of many blocks."""
    for name, value in (("BLOCK", 128), ("PART", 16)):
        monkeypatch.setattr(vc, name, value)
    monkeypatch.setattr(rt, "BLOCK_ROWS", 8)
    monkeypatch.setattr(rt, "FIRST", 30)
    rng = np.random.default_rng(1)
    vectors = clustered(400, 2) if kind == "clustered" else rng.normal(size=(400, 8)).tolist()
    asked = [(i, 1 + i % 2, (i % 3 if i % 4 == 0 else None), ([0, 1, 8, 77] if i % 5 == 0 else None), v) for i, v in enumerate(clustered(20, 3) if kind == "clustered" else rng.normal(size=(20, 8)).tolist())]
    emb, chunks, docs = tables(spark, vectors)
    q = spark.createDataFrame(asked, QUESTIONS)
    assert found(rt.vector_hits(q, emb, chunks, docs)) == brute(vectors, asked)


def test_odd_vectors(spark):
    vectors = [*clustered(60, 4), None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [1e30] * 8, [1e-30] * 8, *[[0.5] * 8] * 4]
    asked = [(1, 1, None, None, [1.0] * 8), (2, 1, None, None, [0.0] * 8), (3, 1, None, None, None), (4, 1, None, [], [3.0, 1.0]), (5, 9, None, None, [1.0] * 8), (6, 2, 99, None, [1.0] * 8)]
    emb, chunks, docs = tables(spark, vectors)
    got = found(rt.vector_hits(spark.createDataFrame(asked, QUESTIONS), emb, chunks, docs))
    expected = brute([v if v is None or len(v) != 8 or not np.isfinite(v).all() else (np.array(v) / np.abs(v).max()).tolist() if any(v) else v for v in vectors], asked)
    assert [(a, b, round(s, 6)) for a, b, _, s in got] == [(a, b, round(s, 6)) for a, b, _, s in expected]
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    assert found(rt.vector_hits(spark.createDataFrame(asked, QUESTIONS), none, chunks, docs)) == []
    assert found(rt.vector_hits(spark.createDataFrame([], QUESTIONS), emb, chunks, docs)) == []


def test_cells_are_skipped_and_appended(spark, monkeypatch):
    """On clustered vectors most cells cannot hold a better one; sets that are appended or superseded count at once."""
    monkeypatch.setattr(rt, "FIRST", 30)
    vectors = clustered(600, 5)
    emb, chunks, docs = tables(spark, vectors)
    cells = rt.stored_cells(emb.where("chunk_id < 400"), chunks, docs, "1")
    owned = chunks.join(docs.selectExpr("id as document_id", "owner_id"), "document_id").selectExpr("id as chunk_id", "owner_id")
    for _ in range(2):  # a repeated append counts once
        cells.append(emb.where("chunk_id >= 400").join(owned, "chunk_id"), "2")
    asked = [(i, 1, None, None, v) for i, v in enumerate(clustered(10, 5))]
    q = spark.createDataFrame(asked, QUESTIONS)
    assert found(rt.vector_hits(q, None, chunks, docs, cells=cells)) == brute(vectors, asked)
    units = vc.units(q, ["question_id", "owner_id"], "vector")
    bounds = rt.cell_bounds(units, cells).join(rt.vector_hits(q, None, chunks, docs, cells=cells).where("rank_order = 5").select("question_id", "score"), "question_id")
    total, visited = bounds.count(), bounds.where("bound >= score").count()
    assert total > 300 and visited < total / 3
    # Every vector of a cell lies within what the cell says it reaches.
    wrong = cells.table("members").join(cells.table("centres").select("owner_id", "cell", "segment", F.col("unit").alias("c"), "reach"), ["owner_id", "cell", "segment"])
    cosine = F.aggregate(F.zip_with("unit", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    assert wrong.where(F.acos(F.least(cosine, F.lit(1.0))) > F.col("reach") + 1e-6).count() == 0
    cells.compact(chunks.where("is_active").selectExpr("id as chunk_id"), "3")
    assert cells.versions() == ["3"] and found(rt.vector_hits(q, None, chunks, docs, cells=cells)) == brute(vectors, asked)
