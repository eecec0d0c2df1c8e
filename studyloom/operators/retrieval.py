"""Vector, text and substring search for batches of questions.

Questions carry their scope: question_id, owner_id, subject_id (nullable), document_ids (nullable array),
query, and for vector search ``vector``.  No step forms question-chunk pairs other than hits.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from studyloom.operators.numbering import fresh, unfold
from studyloom.operators.lists import cascade, citations, top_k
from studyloom.session import checkpoint_dir, cut
from studyloom.sources.search_index import tokens
from studyloom.sources.vector_cells import VectorCells, matrix, units

# Fixed values of retrieval.
TOP_K, MIN_SCORE, SUBSTRING_SCORE = 5, 0.05, 0.01

# Questions that meet a part of a cell at once; vectors a question meets, about, before it has a score to beat.
BLOCK_ROWS, FIRST = 1024, 4096
QUERIES_PER_ARRAY = 500


def scoped_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Active chunks of READY documents with owner and subject."""
    d = docs.filter("status = 'READY'").select(F.col("id").alias("document_id"), "owner_id", "subject_id")
    return (chunks.filter("is_active").select(F.col("id").alias("chunk_id"), "document_id", "content")
            .join(d, "document_id"))


def in_scope(subject: Column, document: Column, q_subject: Column | None = None, q_documents: Column | None = None) -> Column:
    """Chunk columns against the question's scope: document list, else subject, else everything of the owner."""
    q_subject = F.col("q_subject") if q_subject is None else q_subject
    q_documents = F.col("q_documents") if q_documents is None else q_documents
    listed = F.coalesce(F.size(q_documents), F.lit(0)) > 0
    return F.when(listed, F.coalesce(F.array_contains(q_documents, document), F.lit(False))).otherwise(
        q_subject.isNull() | F.coalesce(subject == q_subject, F.lit(False)))


def scope_columns(questions: DataFrame) -> DataFrame:
    have = questions.columns
    subject = F.col("subject_id") if "subject_id" in have else F.lit(None)
    listed = F.col("document_ids") if "document_ids" in have else F.lit(None)
    return questions.withColumns({"q_subject": subject.cast("long"), "q_documents": listed.cast("array<long>")})


def _bounds(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Best cosine that a vector of each cell of the owner can have with each question of the block."""
    width = key[1].as_py()
    cosine = matrix(left["unit"], width) @ matrix(right["unit"], width).T if left.num_rows and right.num_rows else np.zeros((left.num_rows, right.num_rows))
    angle = np.arccos(np.clip(cosine, -1, 1)) - right["reach"].to_numpy()
    best = np.cos(np.maximum(angle, 0)).ravel()
    q, c = (pa.array(x.ravel()) for x in np.indices(cosine.shape))
    return pa.table({"question_id": left["question_id"].take(q), **{n: right[n].take(c) for n in ("owner_id", "dim", "cell", "segment", "vectors", "parts")}, "bound": pa.array(best)})


def cell_bounds(asked: DataFrame, cells: VectorCells) -> DataFrame:
    """(question_id, owner_id, dim, cell, segment, vectors, parts, bound) for every question and cell of its owner; vectors do not travel."""
    centres = cells.lookup("centres", asked, ["owner_id"], ["dim", "cell", "segment", "unit", "reach", "vectors", "parts"])
    key = ["owner_id", "dim"]
    sizes = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks"))
    left = asked.join(sizes, key).select(*key, F.pmod(F.xxhash64("question_id"), F.col("_blocks")).cast("int").alias("_block"), "question_id", "unit")
    right = unfold(centres.join(sizes, key), centres.columns, F.sequence(F.lit(0), F.col("_blocks") - 1), "_i", "_block").drop("_i")
    kind = asked.schema["question_id"].dataType.simpleString()
    return left.groupBy(*key, "_block").cogroup(fresh(right).groupBy(*key, "_block")).applyInArrow(
        _bounds, f"question_id {kind}, owner_id long, dim int, cell long, segment string, vectors long, parts int, bound double")


def _best(k: int):
    """Top ``k`` chunks of one part of a cell for each question of a block, by one matrix product."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("question_id"), right.sort_by("chunk_id")
        width = key[1].as_py()
        score = matrix(left["unit"], width) @ matrix(right["unit"], width).T if left.num_rows and right.num_rows else np.zeros((left.num_rows, right.num_rows))
        listed, sizes = left["q_documents"], pc.fill_null(pc.list_value_length(left["q_documents"]), 0).to_numpy()
        documents, code = np.unique(right["document_id"].to_numpy(), return_inverse=True)
        wanted = pc.list_flatten(listed).to_numpy(zero_copy_only=False).astype(np.float64)  # null elements become NaN and match nothing
        at = np.searchsorted(documents, wanted)
        there = (at < len(documents)) & (documents[np.minimum(at, len(documents) - 1)] == wanted) if len(documents) else np.zeros(len(wanted), bool)
        allowed = np.zeros((len(sizes), len(documents)), bool)
        allowed[np.repeat(np.arange(len(sizes)), sizes)[there], at[there]] = True
        subject, q_subject = (t[c].to_numpy(zero_copy_only=False).astype(np.float64) for t, c in ((right, "subject_id"), (left, "q_subject")))
        by_subject = np.isnan(q_subject)[:, None] | (q_subject[:, None] == subject[None])
        ok = np.where((sizes > 0)[:, None], allowed[:, code], by_subject)
        order = np.argsort(np.where(ok, -score, np.inf), axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(order)), order.shape[1])
        column = order.ravel()
        hit = ok[row, column]
        q, c = pa.array(row[hit]), pa.array(column[hit])
        return pa.table({"question_id": left["question_id"].take(q), "chunk_id": right["chunk_id"].take(c), "document_id": right["document_id"].take(c), "score": pa.array(score[row, column][hit])})

    return run


def meet_cells(pairs: DataFrame, asked: DataFrame, cells: VectorCells, live: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, document_id, score): the best of every visited cell.  A question's vector goes to the cells it visits only; cells
    meet the questions part by part, block by block."""
    key = ["owner_id", "dim", "cell", "segment"]
    members = cells.lookup("members", pairs, ["owner_id", "cell"], ["dim", "segment", "part", "chunk_id", "unit"]).join(live, "chunk_id")
    sizes = pairs.groupBy(*key, "parts").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks"))
    left = pairs.select("question_id", *key, "parts").join(sizes.drop("parts"), key).join(asked.drop("owner_id", "dim"), "question_id")
    block = F.pmod(F.xxhash64("question_id"), F.col("_blocks")).cast("int")
    left = unfold(left, ["question_id", *key, "q_subject", "q_documents", "unit", block.alias("_block")], F.sequence(F.lit(0), F.col("parts") - 1), "_i", "_part").drop("_i")
    right = members.join(sizes, key).withColumn("_part", F.col("part") % F.col("parts"))
    right = unfold(right, [*key, "_part", "chunk_id", "document_id", "subject_id", "unit"], F.sequence(F.lit(0), F.col("_blocks") - 1), "_i", "_block").drop("_i")
    by = [*key, "_part", "_block"]
    kind = asked.schema["question_id"].dataType.simpleString()
    return left.groupBy(*by).cogroup(fresh(right).groupBy(*by)).applyInArrow(_best(k), f"question_id {kind}, chunk_id long, document_id long, score double")


def stored_cells(embeddings: DataFrame, chunks: DataFrame, docs: DataFrame, version: str = "all") -> VectorCells:
    """Cells of the vectors (chunk_id, embedding) in the session's shared folder, by the owner of their document."""
    spark = embeddings.sparkSession
    owner = docs.select(F.col("id").alias("document_id"), "owner_id")
    owned = chunks.select(F.col("id").alias("chunk_id"), "document_id").join(owner, "document_id").select("chunk_id", "owner_id")
    cells = VectorCells(spark, f"{checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}")
    cells.append(embeddings.select("chunk_id", "embedding").join(owned, "chunk_id"), version)
    return cells


def vector_hits(questions: DataFrame, embeddings: DataFrame | None, chunks: DataFrame, docs: DataFrame, k: int = TOP_K,
                cells: VectorCells | None = None) -> DataFrame:
    """X1 before the minimum score: exact top ``k`` by cosine similarity per question.

    Each question visits the likeliest cells, FIRST vectors of them, then only those whose bound reaches its k-th score so far.  One way for
    any number of questions; ``cells`` are the stored ones of the embeddings, else they are made first.
    """
    cells = cells or stored_cells(embeddings, chunks, docs)
    q = scope_columns(questions).withColumn("owner_id", F.col("owner_id").cast("long"))
    asked = cut(units(q, ["question_id", "owner_id", "q_subject", "q_documents"], "vector"))
    live = scoped_chunks(chunks, docs).select("chunk_id", "document_id", "subject_id")
    earlier = W.partitionBy("question_id").orderBy(F.desc("bound"), "cell", "segment").rowsBetween(W.unboundedPreceding, -1)
    bounds = cut(cell_bounds(asked, cells).withColumn("_before", F.coalesce(F.sum("vectors").over(earlier), F.lit(0))))
    first = cut(top_k(meet_cells(bounds.filter(F.col("_before") < FIRST), asked, cells, live, k), "question_id", k))
    least = first.groupBy("question_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("_least"))
    more = bounds.filter(F.col("_before") >= FIRST).join(least, "question_id", "left").filter(F.coalesce(F.col("bound") >= F.col("_least") - 1e-9, F.lit(True)))
    more = more.select(*bounds.columns)
    found = first.drop("rank_order")
    if more.limit(1).count():
        found = found.unionByName(meet_cells(cut(more), asked, cells, live, k))
    return top_k(found, "question_id", k)


def vector_search(questions: DataFrame, embeddings: DataFrame | None, chunks: DataFrame, docs: DataFrame, k: int = TOP_K,
                  min_score: float = MIN_SCORE, cells: VectorCells | None = None) -> DataFrame:
    """The minimum score applies after the top ``k``."""
    return vector_hits(questions, embeddings, chunks, docs, k, cells).filter(F.col("score") >= min_score)


def covers_of(met: Column, terms: Column) -> Column:
    """Sum over the minimal covers of all terms of 0.1 / (1 + other words inside the cover).

    ``met`` are the occurrences (p, t) of the terms in order of their place p.  One pass keeps, per term, its last occurrence and its
    number; a cover is minimal when its left end moves.
    """
    start = F.struct(F.transform(terms, lambda _: F.struct(F.lit(-1).alias("n"), F.lit(-1).alias("p"))).alias("at"), F.lit(-1).alias("n"),
                     F.lit(-1).alias("left"), F.lit(0.0).alias("score"))

    def step(s, o):
        n = s.n + 1
        at = F.transform(s["at"], lambda old, i: F.when(F.get(terms, i) == o.t, F.struct(n.alias("n"), o.p.alias("p"))).otherwise(old))
        first = F.array_min(at)
        left = F.when(first.n < 0, -1).otherwise(first.p)
        noise = (o.p - left) - (n - first.n)
        gain = F.when(left > s.left, 0.1 / (1.0 + noise)).otherwise(0.0)
        return F.struct(at.alias("at"), n.alias("n"), left.alias("left"), (s.score + gain).alias("score"))

    return F.aggregate(met, start, step, lambda s: s.score)


def cover_density(text_tokens: Column, terms: Column) -> Column:
    """``covers_of`` the terms of a text."""
    met = F.filter(F.transform(text_tokens, lambda t, i: F.struct(i.alias("p"), t.alias("t"))), lambda o: F.array_contains(terms, o.t))
    return covers_of(met, terms)


def text_hits(questions: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """X2 before the limit: chunks that contain every term of the question, with cover density.

    Only the rarest term of a question is joined to the postings; the other terms are checked on the
    chunk's own tokens, so frequent words never meet in a join.
    """
    q = scope_columns(questions).select("question_id", "owner_id", "q_subject", "q_documents",
                                         F.array_distinct(tokens(F.col("query"))).alias("terms")).filter(F.size("terms") > 0)
    asked = q.select("question_id", "owner_id", F.explode("terms").alias("term"))
    c = scoped_chunks(chunks, docs)
    posts = (unfold(c, ["owner_id", "chunk_id"], F.array_distinct(tokens(F.col("content"))), "_i", "term").drop("_i")
             .join(asked.select("owner_id", "term").distinct(), ["owner_id", "term"], "left_semi"))
    posts = cut(posts)  # only the postings of asked terms: read twice below, far smaller than the texts
    df = posts.groupBy("owner_id", "term").agg(F.count(F.lit(1)).alias("n"))
    rarest = (asked.join(df, ["owner_id", "term"], "left").groupBy("question_id", "owner_id")
              .agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), F.col("term"))).alias("term"), F.count("n").alias("known")))
    cand = (rarest.join(q, ["question_id", "owner_id"]).filter(F.col("known") == F.size("terms"))
            .join(posts, ["owner_id", "term"]).select("question_id", "chunk_id", "terms", "q_subject", "q_documents"))
    body = c.select("chunk_id", "document_id", "subject_id", "content")
    hits = (cand.join(body, "chunk_id").filter(in_scope(F.col("subject_id"), F.col("document_id")))
            .withColumn("_t", tokens(F.col("content")))
            .filter(F.size(F.array_except("terms", "_t")) == 0))
    return hits.select("question_id", "chunk_id", "document_id", "content",
                       cover_density(F.col("_t"), F.col("terms")).alias("score"))


def text_search(questions: DataFrame, chunks: DataFrame, docs: DataFrame, k: int = TOP_K) -> DataFrame:
    """X2."""
    return top_k(text_hits(questions, chunks, docs), "question_id", k)


def like_pattern(text: Column) -> Column:
    """The pattern as databases read it: a backslash makes the next character stand for itself.

    Spark's LIKE refuses one before a character that is no wild card, so it is dropped there.
    """
    return F.regexp_replace(text, r"\\([^%_\\])|(\\[%_\\])", "$1$2")


def contains_pattern(low: Column, like: Column) -> Column:
    """Does a text in lower case match ``%like%``?  A pattern without wild cards and backslashes needs no pattern engine."""
    wild = F.rlike(like, F.lit(r"[%_\\]"))
    return F.when(wild, F.like(low, F.concat(F.lit("%"), like_pattern(like), F.lit("%")))).otherwise(F.contains(low, like))


def substring_hits(questions: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """X3 before the limit: case-insensitive LIKE of the whole question; % and _ stay wild cards.

    The questions of an owner meet its chunks as arrays of bounded length, spread over as many salted
    arrays as their number asks for; scope is tested before the text, and only matches become rows.
    """
    q = scope_columns(questions)
    salts = q.groupBy("owner_id").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_ARRAY).alias("_salts"))
    arrays = (q.join(salts, "owner_id")
              .withColumn("_salt", F.pmod(F.xxhash64("question_id"), F.col("_salts")))
              .groupBy("owner_id", "_salt").agg(F.collect_list(F.struct(
                  "question_id", "q_subject", "q_documents", F.lower("query").alias("like"))).alias("_qs")))
    c = scoped_chunks(chunks, docs).withColumn("_low", F.lower("content"))
    inside = lambda x: in_scope(F.col("subject_id"), F.col("document_id"), x["q_subject"], x["q_documents"])
    match = F.filter("_qs", lambda x: F.when(inside(x), contains_pattern(F.col("_low"), x["like"])).otherwise(False))
    hits = unfold(c.join(arrays, "owner_id"), ["chunk_id", "document_id", "content"], match, "_i", "_q")
    return hits.select(F.col("_q.question_id").alias("question_id"), "chunk_id", "document_id", "content",
                       F.lit(SUBSTRING_SCORE).alias("score"))


def substring_search(questions: DataFrame, chunks: DataFrame, docs: DataFrame, k: int = TOP_K) -> DataFrame:
    """X3."""
    return top_k(substring_hits(questions, chunks, docs), "question_id", k)


def retrieve(questions: DataFrame, chunks: DataFrame, docs: DataFrame, embeddings: DataFrame | None = None,
             k: int = TOP_K, words=None, grams=None, cells: VectorCells | None = None) -> DataFrame:
    """X4 + U-3: vector search, then text, then substring for the questions still without an answer.

    A question whose vector search returned rows stops there, even if all were below the minimum score.  With stored indexes of
    the chunks (``sources.search_index``; one may serve as both) text and substring search read their lists instead of the texts; ``cells``
    are those of the embeddings.
    """
    from studyloom.operators import indexed_search

    columns = ["question_id", "chunk_id", "document_id", "score", "rank_order"]
    open_, tiers = questions, []
    # Every tier is at most k rows per question; it is kept so that the next one is asked the open questions only.
    if (embeddings is not None or cells is not None) and "vector" in questions.columns:
        hits = cut(vector_hits(questions.filter("vector is not null"), embeddings, chunks, docs, k, cells).select(columns))
        tiers.append((hits.filter(F.col("score") >= MIN_SCORE), hits))
        open_ = open_.join(hits.select("question_id").distinct(), "question_id", "left_anti")
    found = text_search(open_, chunks, docs, k) if words is None else indexed_search.text_search(open_, words, chunks, docs, k)
    text = cut(found.select(columns))
    tiers.append((text, text))
    open_ = cut(open_.join(text.select("question_id").distinct(), "question_id", "left_anti"))
    like = substring_search(open_, chunks, docs, k) if grams is None else indexed_search.substring_search(open_, grams, chunks, docs, k)
    tiers.append((like.select(columns), like))
    served = cascade(tiers, "question_id")
    if words is not None:
        return served.join(words.lookup("texts", served, ["chunk_id"], ["content"]), "chunk_id")
    return served.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id")


def retrieve_citations(*args, **kwargs) -> DataFrame:
    """X4 + K2."""
    return citations(retrieve(*args, **kwargs))
