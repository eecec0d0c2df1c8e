"""Pages, top-k lists, citations and id-set helpers (K, P9, P10, U-1 to U-4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from studyloom.operators.numbering import numbered, top_per_key


def recent_notifications(notifications: DataFrame, unread_only: bool = False, n: int = 100) -> DataFrame:
    """Newest notifications per user."""
    rows = notifications.filter(~F.col("is_read")) if unread_only else notifications
    return top_per_key(rows, ["user_id"], [F.desc("created_at"), F.desc("id")], n, "pos")


def page(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """P10: rows ``offset+1 .. offset+limit`` per key, with the key's total."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return top_per_key(df, keys, order, offset + limit, "pos").filter(F.col("pos") > offset).join(total, list(keys))


def top_k(scored: DataFrame, query_key: str, k: int = 5, tie: str = "chunk_id") -> DataFrame:
    """K1: best ``k`` (1 to 20) rows per query by score, ties by ``tie``."""
    if not 1 <= k <= 20:
        raise ValueError("k must be between 1 and 20")
    return top_per_key(scored, [query_key], [F.desc("score"), F.asc(tie)], k, "rank_order")


def citations(top: DataFrame, query_key: str = "question_id") -> DataFrame:
    """K2: citation rows with rank, similarity and the first 400 characters."""
    return top.select(query_key, "chunk_id", "document_id", "rank_order",
                      F.col("score").cast("decimal(8,6)").alias("similarity_score"),
                      F.substring("content", 1, 400).alias("excerpt"))


def ordered_children(df: DataFrame, parent: str, order: Sequence[Column], bucket: Sequence[Column] = (),
                     limit: int | None = None) -> DataFrame:
    """K3: all children of each parent, numbered in order, or the first ``limit``.

    ``bucket`` follows ``order`` (see ``numbered``), so that a parent with very many children is ranked by several tasks.
    """
    if limit is not None:
        return top_per_key(df, [parent], order, limit, "child_no")
    return numbered(df, [parent], bucket, order, "child_no")


def _joined(top: DataFrame, key: str, line: Column, rank: str) -> DataFrame:
    rows = top.select(key, F.struct(F.col(rank).alias("r"), line.alias("t")).alias("_row"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda x: x.t), "\n\n")
                                 .alias("text"))


def assemble_context(top: DataFrame, key: str = "question_id") -> DataFrame:
    """K4: numbered sources of a query in one text; ``top`` has the rows per query that ``top_k`` was asked for."""
    line = F.concat(F.lit("[SOURCE "), F.col("rank_order").cast("string"), F.lit("] "), F.col("content"))
    return _joined(top, key, line, "rank_order")


def _head(text: str, chars: int | None) -> Column:
    return F.col(text) if chars is None else F.substring(text, 1, chars)


def assemble_deck_context(chunks: DataFrame, key: str = "request_id", first_chunks: int | None = None,
                          chars: int | None = None) -> DataFrame:
    """K4 for card sets: the chunks by document and index, all of them and whole.

    A caller that feeds a bounded prompt passes ``first_chunks`` and ``chars`` (30 and 2500 for one card request).
    """
    order = [F.asc("document_id"), F.asc("chunk_index")]
    first = (numbered(chunks, [key], [F.col("document_id")], order, "_pos") if first_chunks is None
             else top_per_key(chunks, [key], order, first_chunks, "_pos"))
    line = F.concat(F.lit("[CHUNK_ID="), F.col("id").cast("string"), F.lit("]\n"), _head("content", chars))
    return _joined(first, key, line, "_pos")


# Texts of the answer given without a model.
ANSWER_HEAD = "Chưa cấu hình LLM. Đây là các đoạn tài liệu liên quan nhất để bạn kiểm tra:\n\n"
ANSWER_NONE = "Không tìm thấy thông tin liên quan trong các tài liệu đã gắn với cuộc hội thoại."


def retrieval_answer(questions: DataFrame, top: DataFrame, key: str = "question_id", best: int | None = None,
                     chars: int | None = None) -> DataFrame:
    """K5: the chunks found for each question as bullets, or the "nothing found" text.

    ``best`` and ``chars`` bound what is shown of an answer (3 and 700 for one chat message); without them all of it is.
    """
    line = F.concat(F.lit("• "), _head("content", chars))
    found = _joined(top if best is None else top.filter(F.col("rank_order") <= best), key, line, "rank_order")
    return questions.select(key).join(found, key, "left").select(
        key, F.coalesce(F.concat(F.lit(ANSWER_HEAD), "text"), F.lit(ANSWER_NONE)).alias("answer"))


def distinct_ordered(ids: Column) -> Column:
    """U-1: distinct elements of an array in order of first occurrence."""
    return F.array_distinct(ids)


def same_set(a: DataFrame, b: DataFrame, group: str, item: str) -> DataFrame:
    """U-2: per group, do ``a`` and ``b`` hold the same items?  One grouping of the tagged union."""
    tagged = (a.select(group, item, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
              .unionByName(b.select(group, item, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    per_item = tagged.groupBy(group, item).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return per_item.groupBy(group).agg((F.min(F.col("_a") * F.col("_b")) == 1).alias("same"))


def cascade(tiers: Sequence[tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """U-3: union of tiers; a later tier only serves queries an earlier tier did not answer.

    Each tier is (rows, answered): ``answered`` holds the keys that stop the cascade, which for vector
    search are the queries with any row at all, even if every row fell below the minimum score.
    """
    kept, stopped = [], None
    for rows, answered in tiers:
        kept.append(rows if stopped is None else rows.join(stopped, key, "left_anti"))
        keys = answered.select(key).distinct()
        stopped = keys if stopped is None else stopped.unionByName(keys).distinct()
    return reduce(DataFrame.unionByName, kept)


def missing_slots(expected: DataFrame, returned: DataFrame, keys: Sequence[str] = ("request_id", "slot")) -> DataFrame:
    """U-4: expected slots that were not returned."""
    return expected.join(returned.select(*keys), list(keys), "left_anti")
