"""Cloze quizzes from chunks, from source selection to checked questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from studyloom.functions.questions import KEYS, cloze_stem, correct_key, grounding_verdict, let, pick_distractors
from studyloom.functions.text import one_of
from studyloom.operators.access import question_issue
from studyloom.operators.contexts import crop_boundary, evidence_spans, micro_contexts, score_contexts
from studyloom.operators.items import answer_catalogue, distractor_pool
from studyloom.operators.numbering import unfold
from studyloom.operators.planning import (allocate, assign_contexts, candidate_chunks, dedupe_questions,
                                          order_by_section_rank, preselect_answers, source_tier, spread_sample)
from studyloom.session import cut


# Fixed value: terms of a section that one question picks its distractors from, unless the caller names another number.
POOL_TERMS = 80


def question_slots(chunks: DataFrame, requests: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """W10 -> W9 -> W7 -> W8: one row per question to write, with its source chunk.

    Ranks and picks are made without the texts; these are joined to the picked chunks only.
    """
    narrow = chunks.select("request_id", "id", "document_id", "chunk_index", "section_id", source_tier(F.col("content")).alias("_tier"))
    picked = allocate(spread_sample(candidate_chunks(order_by_section_rank(narrow, ranks)), requests)).select(
        "request_id", "slot", "turn", F.col("id").alias("chunk_id"), "section_id")
    body = chunks.select("request_id", F.col("id").alias("chunk_id"), "content")
    return picked.join(body, ["request_id", "chunk_id"]).select("request_id", "slot", "turn", "chunk_id", "section_id", "content")


def slot_contexts(slots: DataFrame) -> DataFrame:
    """C8 -> C9 -> C10 -> W11: the context of each slot.  Each chunk's windows are made once."""
    safe = (slots.select("chunk_id", "content").dropDuplicates(["chunk_id"])
            .withColumn("_c", crop_boundary(F.col("content")))
            .select("chunk_id", F.col("_c.text").alias("text"), F.col("_c.cut").alias("cut"),
                    F.col("_c.original_chars").alias("original_chars"), F.col("_c.safe_chars").alias("safe_chars")))
    ranked = score_contexts(micro_contexts(safe)).select("chunk_id", "rank", F.col("text").alias("context"), "score", "char_count")
    facts = safe.drop("text")
    out = assign_contexts(slots.select("request_id", "slot", "turn", "chunk_id", "section_id"), ranked)
    return out.join(facts, "chunk_id").withColumn("source_ref", F.concat_ws("#", "chunk_id", "rank"))


def build_cloze_quiz(chunks: DataFrame, requests: DataFrame, ranks: DataFrame | None = None, pool_terms: int = POOL_TERMS) -> DataFrame:
    """One checked question per slot that can be served.

    ``chunks``: request_id, id, document_id, chunk_index, section_id, content (see ``usable_chunks``);
    ``requests``: request_id, question_count.  ``verdict`` is "OK" or the reason of rejection.
    ``pool_terms`` bounds the array of a section's terms that travels with a question.
    """
    slots = cut(question_slots(chunks, requests, ranks))
    placed = cut(slot_contexts(slots))
    sources = placed.select("source_ref", F.col("context").alias("text")).dropDuplicates(["source_ref"])
    answers = cut(answer_catalogue(evidence_spans(sources, ["source_ref"])))
    near = answers.groupBy("source_ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("answer_id", "answer"))),
                                                        lambda x: x.answer).alias("near"))
    picked = preselect_answers(placed.select("request_id", "slot", "chunk_id", "section_id", "source_ref"), answers)
    asked = slots.select("section_id").filter("section_id is not null").distinct()
    wanted = chunks.join(asked, "section_id", "left_semi").select("section_id", "id", "document_id", "chunk_index", "content")
    pool = distractor_pool(wanted.dropDuplicates(["id"]), pool_terms)
    q = picked.join(near, "source_ref").join(pool, "section_id", "left")
    key = correct_key(F.col("slot").cast("string"))
    keys = one_of(KEYS)

    def question(stem, three, key):
        texts = F.array_insert(three, F.array_position(keys, key).cast("int"), F.col("answer"))
        options = F.transform(texts, lambda x, i: F.struct(
            F.element_at(keys, i + 1).alias("option_key"), x.alias("option_text"),
            (F.element_at(keys, i + 1) == key).alias("is_correct"), (i + 1).alias("position")))
        return F.when(stem.isNotNull() & three.isNotNull(), F.array(F.struct(
            stem.alias("question_text"), key.alias("key"), options.alias("options"))))

    three = pick_distractors(F.lit(None).cast("array<string>"), F.col("answer"), F.col("evidence"), F.col("near"), F.col("pool"))
    made = let(cloze_stem(F.col("answer"), F.col("evidence")), lambda s: let(three, lambda d: let(key, lambda k: question(s, d, k))))
    # Exploding an array that is null for unusable slots drops them without evaluating the rules twice.
    rest = ["request_id", "slot", "chunk_id", "section_id", "answer", "evidence"]
    q = unfold(q, rest, made, "_i", "_q").select(
        "request_id", "slot", "chunk_id", "section_id", "answer", "evidence", "_q.*")
    body = slots.select("chunk_id", "content").dropDuplicates(["chunk_id"])
    checked = q.join(body, "chunk_id").withColumn("verdict", F.coalesce(
        question_issue(F.col("question_text"), F.col("options")),
        grounding_verdict(F.col("content"), F.col("question_text"), F.col("options"), F.col("evidence"))))
    return checked.select("request_id", "slot", "chunk_id", "section_id", "question_text", "answer", "evidence", "key",
                          "options", "verdict")


def accepted_questions(quiz: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Questions that passed, distinct by text inside a request."""
    rows = quiz.filter("verdict = 'OK'").withColumn("question_order", F.col("slot"))
    return dedupe_questions(rows, used, "request_id")


def gate_summary(verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    """Items per verdict."""
    return verdicts.groupBy(F.col(column).alias("reason")).agg(F.count(F.lit(1)).alias("items"))
