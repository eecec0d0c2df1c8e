"""The stored search index against the searches that read every text."""

import random

import pytest
from pyspark.sql import functions as F

from studyloom.operators import indexed_search as ix, retrieval as rt
from studyloom.sources import search_index as si

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa giá trị hàng hóa Đông x1 a_b 100% c\\d ΑΣ".split()
CHUNKS = "id long, document_id long, is_active boolean, content string"


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, i % 6, True, " ".join(rng.choice(WORDS[:6] if i % 3 else WORDS) for _ in range(rng.randint(0, 30)))) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    # One owner holds most of the documents; one document is not ready.
    return spark.createDataFrame([(d, 1 if d < 4 else 2, d % 2, "READY" if d != 3 else "PROCESSING") for d in range(6)], "id long, owner_id long, subject_id long, status string")


def questions(spark, seed=5, n=60):
    rng = random.Random(seed)
    asked = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    asked += ["", "   ", "al", "a%a", "%", "_", "ph_ ", "100\\%", "c\\\\d", "ALPHA%BETA", "a_b", "missingword", "alpha missingword", "hóa", "ας", "a" * 300]
    return spark.createDataFrame([(i, 1 + i % 2, (i % 2 if i % 5 == 0 else None), ([0, 4] if i % 7 == 0 else None), q) for i, q in enumerate(asked)],
                                 "question_id long, owner_id long, subject_id long, document_ids array<long>, query string")


def indexed(spark, path, chunks, docs, index=None, version="1"):
    index = index or si.SearchIndex(spark, str(path))
    owned = chunks.join(docs.select(F.col("id").alias("document_id"), "owner_id"), "document_id")
    index.append(owned.select("owner_id", F.col("id").alias("chunk_id"), "content"), version)
    return index


def equal(q, index, chunks, docs):
    plain = lambda df: sorted((r.question_id, r.rank_order, r.chunk_id, r.document_id, round(r.score, 9)) for r in df.collect())
    text, like = plain(ix.text_search(q, index, chunks, docs)), plain(ix.substring_search(q, index, chunks, docs))
    assert text == plain(rt.text_search(q, chunks, docs)) and like == plain(rt.substring_search(q, chunks, docs))
    return text, like


def test_index_equals_reading_every_text(spark, docs, tmp_path):
    chunks = spark.createDataFrame([*corpus(200, 1), (900, 1, True, None), (901, 1, False, "alpha beta")], CHUNKS).repartition(3)
    text, like = equal(questions(spark), indexed(spark, tmp_path, chunks, docs), chunks, docs)
    assert len(text) > 50 and len(like) > 50


def test_appended_and_superseded_sets(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(si, "PART", 32)  # many parts a list
    q, first = questions(spark, 6, 30), corpus(150, 2)
    one = spark.createDataFrame(first, CHUNKS)
    index = indexed(spark, tmp_path, one, docs)
    added = [(1000 + i, d, a, t) for i, d, a, t in corpus(80, 3)]
    two = spark.createDataFrame(added, CHUNKS)
    indexed(spark, tmp_path, two, docs, index, "2")
    indexed(spark, tmp_path, two, docs, index, "2")  # a repeated append counts once
    assert index.versions() == ["1", "2"]
    # The first set of two documents is superseded by the second.
    current = spark.createDataFrame([(i, d, d not in (0, 4), t) for i, d, _, t in first] + added, CHUNKS)
    before = equal(q, index, current, docs)
    index.compact(current.where("is_active").selectExpr("id as chunk_id"), "3")
    assert index.versions() == ["3"] and index.table("texts").count() == current.where("is_active").count()
    assert equal(q, index, current, docs) == before


def test_no_text_is_read_for_words(spark, docs, tmp_path):
    """Text search reads postings of its buckets only; substring search compares few texts with the pattern."""
    chunks = spark.createDataFrame([*corpus(300, 4), (5000, 0, True, "only here: quetzalcoatl")], CHUNKS)
    index = indexed(spark, tmp_path, chunks, docs)
    q = spark.createDataFrame([(1, 1, "quetzalcoatl"), (2, 1, "zalco%atl")], "question_id long, owner_id long, query string")
    plan = ix.text_matches(q.limit(1), index, chunks.select("id", "document_id", "is_active"), docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan
    found = index.lookup("postings", spark.createDataFrame([(1, "quetzalcoatl")], "owner_id long, term string"), ["owner_id", "term"], ["chunk_id"])
    files = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in files or "bucket#" in files.split("PartitionFilters:")[1].split("]")[0]
    candidates, whole = ix.substring_candidates(q, index, chunks, docs)
    assert sorted(tuple(r) for r in candidates.select("question_id", "chunk_id").collect()) == [(1, 5000), (2, 5000)] and whole.count() == 0


def test_scores_are_bounded_and_few_are_computed(spark, docs, tmp_path):
    """Chunks whose bound is under the k-th score are left out, and none of them would have been among the best."""
    rows = [(i, 0, True, "alpha " + "noise " * (i % 9) + "beta") for i in range(200)] + [(500 + i, 0, True, "alpha beta " * (3 + i)) for i in range(6)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    index = indexed(spark, tmp_path, chunks, docs)
    q = spark.createDataFrame([(1, 1, "beta alpha")], "question_id long, owner_id long, query string")
    matches = ix.text_matches(q, index, chunks, docs).collect()
    scores = {r.chunk_id: r.score for r in rt.text_hits(q, chunks, docs).collect()}
    assert {r.chunk_id for r in matches} == set(scores) and all(r.bound >= scores[r.chunk_id] - 1e-9 for r in matches)
    best = sorted(scores.values())[-5]
    assert sum(r.bound >= best for r in matches) < 10
    equal(q, index, chunks, docs)


def test_empty_index(spark, docs, tmp_path):
    none = spark.createDataFrame([], CHUNKS)
    equal(questions(spark, 7, 5), si.SearchIndex(spark, str(tmp_path / "never")), none, docs)
    equal(questions(spark, 7, 5), indexed(spark, tmp_path / "empty", none, docs), none, docs)


def test_upper_case_of_questions_is_that_of_the_sql(spark, tmp_path):
    """Letters whose upper case Java writes as several: a question in capitals still finds its text."""
    import duckdb

    from studyloom.plans import retrieval_queries as rq
    from studyloom.plans.views import Learning

    letters = "ßẞŉǰΐΰևẖﬁﬃᾀᾗᾧᾳῃῳᾼέäéığşđŐ"
    texts = [f"Enlich schß{c}. {c}rest more" for c in letters] + ["", "one", "Straße GROß x y"]
    spark.createDataFrame([(4 * i, t) for i, t in enumerate(texts)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.question_id: r.q2 for r in rq.asked(Learning(spark, str(tmp_path))).collect()}
    wanted = duckdb.sql(f"select item_id, upper(array_to_string(string_split(text, ' ')[1:2], ' ')) from '{tmp_path}/benchmark.parquet/*.parquet'").fetchall()
    assert got == dict(wanted)
    chunks = spark.createDataFrame([(1, 0, True, "ré enmenteauon Enlich schß. Ö. Das")], CHUNKS)
    docs = spark.createDataFrame([(0, 1, 1, "READY")], "id long, owner_id long, subject_id long, status string")
    q = spark.createDataFrame([(1, 1, "Enlich schß.")], "question_id long, owner_id long, query string").withColumn("query", rq.tx.upper_each(F.col("query")))
    assert [r.chunk_id for r in ix.substring_search(q, indexed(spark, tmp_path / "index", chunks, docs), chunks, docs).collect()] == [1]


def test_large_batches_are_indexed_in_slices():
    """Postings and trigram lists of one large Arrow batch come in several, with the rows that the whole batch holds."""
    import pyarrow as pa

    rng, n = random.Random(3), 12_000
    texts = [" ".join(f"word{rng.randint(0, 999)}" for _ in range(rng.choice([0, 90, 110]))) for _ in range(n)]
    ids, owner = pa.array(range(n), pa.int64()), pa.array([i % 3 for i in range(n)], pa.int64())
    rows = lambda name, column: iter([pa.RecordBatch.from_arrays([owner, ids, column], ["owner_id", "chunk_id", name])])
    posted = list(si._postings(rows("tokens", pa.array([t.split() for t in texts], pa.list_(pa.string())))))
    assert len(posted) > 1 and sum(b.num_rows for b in posted) == sum(len(set(t.split())) for t in texts)
    assert sum(len(b.column("positions").flatten()) for b in posted) == sum(len(t.split()) for t in texts)
    listed = list(si._gram_lists(rows("low", pa.array(texts))))
    assert len(listed) > 1 and sum(len(b.column("ids").flatten()) for b in listed) == sum(len(si.gram_codes(t)) for t in texts)
