"""Text and substring search (X2, X3) from a stored index (``sources.search_index``).

The results are those of ``retrieval.text_search`` and ``retrieval.substring_search`` on the same chunks; texts are not split again, and no
text is read but those that a substring may be in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from studyloom.operators.lists import top_k
from studyloom.operators.retrieval import SUBSTRING_SCORE, TOP_K, contains_pattern, covers_of, in_scope, scope_columns, substring_hits
from studyloom.session import cut
from studyloom.sources.search_index import SearchIndex, gram_codes, tokens

# Rarest trigrams of a pattern whose lists are intersected; what is left is compared with the pattern anyway.
RAREST = 8


def live_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(chunk_id, document_id, owner_id, subject_id) of what may be found; no text is read."""
    d = docs.filter("status = 'READY'").select(F.col("id").alias("document_id"), F.col("owner_id").alias("_owner"), "subject_id")
    return chunks.filter("is_active").select(F.col("id").alias("chunk_id"), "document_id").join(d, "document_id")


def scoped(candidates: DataFrame, questions: DataFrame, live: DataFrame) -> DataFrame:
    """Candidates (question_id, owner_id, chunk_id) that are live and in the scope of their question, with their document."""
    scope = questions.select("question_id", "q_subject", "q_documents")
    rows = candidates.join(live, (candidates["chunk_id"] == live["chunk_id"]) & (candidates["owner_id"] == live["_owner"])).drop(live["chunk_id"])
    rows = rows.join(scope, "question_id").filter(in_scope(F.col("subject_id"), F.col("document_id")))
    return rows.select(*candidates.columns, "document_id")


# --------------------------------------------------------------------------------------------- X2
def text_matches(questions: DataFrame, index: SearchIndex, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, owner_id, chunk_id, document_id, terms, bound): chunks with every term of a question.

    The postings of a question's rarest term give the candidates, its other terms are looked up for these alone.  With t occurrences
    of m terms there are at most t - m + 1 covers, so ``bound`` is what a chunk can score at best.
    """
    q = scope_columns(questions)
    asked = cut(q.select("question_id", "owner_id", "q_subject", "q_documents", F.array_distinct(tokens(F.col("query"))).alias("terms")).filter(F.size("terms") > 0))
    terms = asked.select("question_id", "owner_id", F.explode("terms").alias("term"))
    known = index.counts("terms", terms, ["owner_id", "term"])
    rarest = (terms.join(known, ["owner_id", "term"]).groupBy("question_id", "owner_id")
              .agg(F.min_by("term", F.struct("chunks", "term")).alias("term"), F.count(F.lit(1)).alias("known")))
    rarest = cut(rarest.join(asked.select("question_id", "terms"), "question_id").filter(F.col("known") == F.size("terms")).drop("known"))
    first = index.lookup("postings", rarest, ["owner_id", "term"], ["chunk_id", "tf"])
    found = rarest.join(first, ["owner_id", "term"]).select("question_id", "owner_id", "chunk_id", "term", "terms", "tf")
    found = cut(scoped(found, asked, live_chunks(chunks, docs)))
    more = found.filter(F.size("terms") > 1).select("question_id", "owner_id", "chunk_id", F.explode(F.array_remove("terms", F.col("term"))).alias("term"))
    others = index.lookup("postings", terms, ["owner_id", "term"], ["chunk_id", F.col("tf").alias("more")])
    held = more.join(others, ["owner_id", "term", "chunk_id"]).groupBy("question_id", "chunk_id").agg(F.count(F.lit(1)).alias("held"), F.sum("more").alias("more"))
    both = found.join(held, ["question_id", "chunk_id"], "left").filter(F.coalesce("held", F.lit(0)) == F.size("terms") - 1)
    covers = F.col("tf") + F.coalesce("more", F.lit(0)) - F.size("terms") + 1
    return both.select("question_id", "owner_id", "chunk_id", "document_id", "terms", (0.1 * covers).alias("bound"))


def scored(matches: DataFrame, index: SearchIndex) -> DataFrame:
    """``matches`` with their cover density as ``score``, from the positions of their terms."""
    wanted = matches.select("question_id", "owner_id", "chunk_id", F.posexplode("terms").alias("number", "term"))
    places = index.lookup("postings", wanted, ["owner_id", "term"], ["chunk_id", "positions"])
    met = wanted.join(places, ["owner_id", "term", "chunk_id"]).groupBy("question_id", "chunk_id").agg(
        F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("p"), F.col("number").alias("t")))).alias("_lists"))
    rows = matches.join(met, ["question_id", "chunk_id"]).withColumn("_met", F.array_sort(F.flatten("_lists"))).drop("_lists")
    return rows.withColumn("score", covers_of(F.col("_met"), F.transform("terms", lambda _, i: i))).drop("_met")


def text_search(questions: DataFrame, index: SearchIndex, chunks: DataFrame, docs: DataFrame, k: int = TOP_K) -> DataFrame:
    """(question_id, chunk_id, document_id, score, rank_order).

    The chunks of the ``k`` best bounds are scored first; others only if their bound reaches the k-th score so found.
    """
    matches = cut(text_matches(questions, index, chunks, docs))
    leaders = top_k(matches.withColumn("score", F.col("bound")), "question_id", k).drop("score", "rank_order")
    done = cut(scored(leaders, index))
    least = done.groupBy("question_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    rest = matches.join(done.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti").join(least, "question_id")
    # A bound is a product, a score a sum: they may differ in the last digits.  A single term's bound is its score.
    rest = rest.filter((F.size("terms") > 1) & ((F.col("n") < k) | (F.col("bound") >= F.col("least") - 1e-9))).drop("least", "n")
    columns = ["question_id", "chunk_id", "document_id", "score"]
    total = done.select(columns)
    rest = cut(rest)
    if rest.limit(1).count():
        total = total.unionByName(scored(rest, index).select(columns))
    return top_k(total, "question_id", k)


# --------------------------------------------------------------------------------------------- X3
def literals(pattern: Column) -> Column:
    """Literal runs of a LIKE pattern: what stands between wild cards, a backslash taken off the character that it makes literal."""
    runs = F.regexp_extract_all(pattern, F.lit(r"(?s)((?:[^%_\\]|\\.)+)"), 1)
    return F.transform(runs, lambda r: F.regexp_replace(r, r"(?s)\\(.)", "$1"))


def _question_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted({int(g) for run in runs for g in gram_codes(run)}) for runs in b.column("runs").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("question_id"), b.column("owner_id"), pa.array(found, pa.list_(pa.int64()))], ["question_id", "owner_id", "grams"])


def substring_candidates(questions: DataFrame, index: SearchIndex, chunks: DataFrame, docs: DataFrame, rarest: int = RAREST) -> tuple[DataFrame, DataFrame]:
    """(candidates, whole): chunks in scope that hold the rarest trigrams of a question's pattern, and the ids of the questions without any
    trigram, which no list can serve.

    Lists are intersected part by part, so none of an owner is gathered whole.
    """
    q = scope_columns(questions)
    kind = q.schema["question_id"].dataType.simpleString()
    runs = q.select("question_id", F.col("owner_id").cast("long").alias("owner_id"), literals(F.lower("query")).alias("runs")).where("query is not null")
    grams = cut(runs.mapInArrow(_question_grams, f"question_id {kind}, owner_id long, grams array<long>"))
    each = grams.select("question_id", "owner_id", F.explode("grams").alias("gram"))
    sizes = index.counts("gram_sizes", each, ["owner_id", "gram"])
    known = each.join(sizes, ["owner_id", "gram"]).groupBy("question_id", "owner_id").agg(
        F.count(F.lit(1)).alias("known"), F.slice(F.array_sort(F.collect_list(F.struct("chunks", "gram"))), 1, rarest).alias("few"))
    known = known.join(grams.select("question_id", "grams"), "question_id").filter(F.col("known") == F.size("grams"))
    picked = cut(known.select("question_id", "owner_id", F.size("few").alias("wanted"), F.explode("few.gram").alias("gram")))
    lists = index.lookup("grams", picked, ["owner_id", "gram"], ["part", "ids"])
    whole_lists = picked.join(lists, ["owner_id", "gram"]).groupBy("question_id", "owner_id", "wanted", "part", "gram").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    met = whole_lists.groupBy("question_id", "owner_id", "wanted", "part").agg(F.collect_list(F.struct(F.size("ids").alias("n"), F.col("ids"))).alias("lists"))
    met = met.filter(F.size("lists") == F.col("wanted")).withColumn("lists", F.array_sort("lists"))
    common = F.aggregate(F.slice(F.col("lists.ids"), 2, rarest), F.element_at(F.col("lists.ids"), 1), lambda a, b: F.array_intersect(a, b))
    candidates = met.select("question_id", "owner_id", F.explode(F.array_distinct(common)).alias("chunk_id"))
    return scoped(candidates, q, live_chunks(chunks, docs)), grams.filter(F.size("grams") == 0).select("question_id")


def substring_search(questions: DataFrame, index: SearchIndex, chunks: DataFrame, docs: DataFrame, k: int = TOP_K) -> DataFrame:
    """(question_id, chunk_id, document_id, score, rank_order).

    Survivors of the trigram lists are compared with the whole pattern.  Patterns whose literal parts are all under three
    characters go over the texts of their owner instead, as ``retrieval.substring_hits`` does.
    """
    candidates, whole = substring_candidates(questions, index, chunks, docs)
    candidates = cut(candidates)
    texts = index.lookup("texts", candidates, ["chunk_id"], ["content"])
    low = questions.select("question_id", F.lower("query").alias("_like"))
    rows = candidates.join(texts, "chunk_id").join(low, "question_id")
    rows = rows.filter(contains_pattern(F.lower("content"), F.col("_like")))
    found = rows.select("question_id", "chunk_id", "document_id", F.lit(SUBSTRING_SCORE).alias("score"))
    if whole.limit(1).count():
        short = questions.join(whole, "question_id", "left_semi")
        found = found.unionByName(substring_hits(short, chunks, docs).select(found.columns))
    return top_k(found, "question_id", k)
