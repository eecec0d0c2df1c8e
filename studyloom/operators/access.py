"""Who may use which rows (P1-P8) and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from studyloom.functions.text import norm_compare, strip


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def usable_chunks(chunks: DataFrame, docs: DataFrame, scope: DataFrame) -> DataFrame:
    """Active chunks of the owner's READY documents, by document list, else subject, else all.

    ``scope``: request_id, owner_id, subject_id (nullable), document_ids (nullable array).
    Three equi-joins instead of one join on a disjunction.
    """
    ready = docs.filter(F.col("status") == "READY").select(
        F.col("id").alias("document_id"), F.col("owner_id"), F.col("subject_id"))
    listed = F.coalesce(F.size("document_ids"), F.lit(0)) > 0
    by_list = (scope.filter(listed)
               .select("request_id", "owner_id", F.explode(F.array_distinct("document_ids")).alias("document_id"))
               .join(ready.drop("subject_id"), ["owner_id", "document_id"]))
    by_subject = (scope.filter(~listed & F.col("subject_id").isNotNull()).drop("document_ids")
                  .join(ready, ["owner_id", "subject_id"]).drop("subject_id"))
    by_owner = (scope.filter(~listed & F.col("subject_id").isNull()).drop("document_ids", "subject_id")
                .join(ready.drop("subject_id"), "owner_id"))
    wanted = _union([d.select("request_id", "document_id") for d in (by_list, by_subject, by_owner)])
    return wanted.join(chunks.filter("is_active"), "document_id")


def check_subject(reqs: DataFrame, subjects: DataFrame) -> DataFrame:
    """Requests whose subject is missing or foreign (both look like "not found")."""
    owned = subjects.select(F.col("id").alias("subject_id"), "owner_id")
    return (reqs.filter(F.col("subject_id").isNotNull())
            .join(owned, ["subject_id", "owner_id"], "left_anti").withColumn("reason", F.lit("Subject not found")))


def _verdicts(wanted: DataFrame, allowed: DataFrame, item: str) -> DataFrame:
    hit = allowed.select("request_id", item).distinct().withColumn("_ok", F.lit(1))
    return (wanted.join(hit, ["request_id", item], "left").groupBy("request_id")
            .agg(F.count(F.lit(1)).alias("requested"), F.count("_ok").alias("accessible"))
            .withColumn("ok", F.col("requested") == F.col("accessible")))


def check_documents(reqs: DataFrame, docs: DataFrame) -> DataFrame:
    """Per request, are all distinct document ids owned and inside the subject (if one is named)?"""
    wanted = reqs.select("request_id", "owner_id", "subject_id",
                         F.explode(F.array_distinct("document_ids")).alias("document_id"))
    d = docs.select(F.col("id").alias("document_id"), F.col("owner_id"), F.col("subject_id").alias("_subject"))
    allowed = wanted.join(d, ["document_id", "owner_id"]).filter(
        F.col("subject_id").isNull() | (F.col("_subject") == F.col("subject_id")))
    return _verdicts(wanted.select("request_id", "document_id"), allowed, "document_id")


def check_chunks(reqs: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Per request, are all distinct chunk ids active, owned, in the allowed documents and subject?"""
    wanted = reqs.select("request_id", "owner_id", "subject_id", "document_ids",
                         F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    c = chunks.filter("is_active").select(F.col("id").alias("chunk_id"), "document_id")
    d = docs.select(F.col("id").alias("document_id"), F.col("owner_id"), F.col("subject_id").alias("_subject"))
    allowed = (wanted.join(c, "chunk_id").join(d, ["document_id", "owner_id"])
               .filter(F.col("subject_id").isNull() | (F.col("_subject") == F.col("subject_id")))
               .filter((F.coalesce(F.size("document_ids"), F.lit(0)) <= 0)
                       | F.array_contains("document_ids", F.col("document_id"))))
    return _verdicts(wanted.select("request_id", "chunk_id"), allowed, "chunk_id")


def visible_quizzes(requests: DataFrame, quizzes: DataFrame) -> DataFrame:
    """P5: of the requested (user_id, quiz_id) pairs, those the user may open."""
    q = quizzes.select(F.col("id").alias("quiz_id"), "owner_id", "title", "status", "visibility")
    return requests.join(q, "quiz_id").filter(
        (F.col("owner_id") == F.col("user_id"))
        | ((F.col("status") == "PUBLISHED") & F.col("visibility").isin("PUBLIC", "UNLISTED")))


def visible_decks(requests: DataFrame, decks: DataFrame) -> DataFrame:
    """Of the requested (user_id, deck_id) pairs, those the user may open."""
    d = decks.select(F.col("id").alias("deck_id"), "owner_id", "title", "visibility")
    return requests.join(d, "deck_id").filter(
        (F.col("owner_id") == F.col("user_id")) | F.col("visibility").isin("PUBLIC", "UNLISTED"))


def nested_options(options: DataFrame, *fields: str) -> DataFrame:
    """Options of a question as one array ordered by position (at most one per position 1-4)."""
    return (options.groupBy("question_id")
            .agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias("options")))


def quiz_view(requests: DataFrame, quizzes: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Questions with options for each (user_id, quiz_id); key, explanation and source for the owner only."""
    opts = nested_options(options, "option_key", "option_text", "is_correct")
    opened = visible_quizzes(requests, quizzes).select(
        "user_id", "quiz_id", (F.col("owner_id") == F.col("user_id")).alias("owner"))
    q = questions.withColumnRenamed("id", "question_id").join(opts, "question_id", "left")
    mine = F.col("owner")
    return opened.join(q, "quiz_id").select(
        "user_id", "quiz_id", "question_id", "question_order", "question_text",
        F.when(mine, F.col("explanation")).alias("explanation"),
        F.when(mine, F.col("source_chunk_id")).alias("source_chunk_id"),
        F.transform("options", lambda o: F.struct(
            o.position.alias("position"), o.option_key.alias("option_key"), o.option_text.alias("option_text"),
            F.when(mine, o.is_correct).alias("is_correct"))).alias("options"))


def attempt_sheet(attempts: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Questions and options of each attempt without keys, explanations or sources."""
    opts = nested_options(options, "option_key", "option_text")
    q = (questions.select(F.col("id").alias("question_id"), "quiz_id", "question_order", "question_text")
         .join(opts, "question_id", "left"))
    return attempts.select(F.col("id").alias("attempt_id"), "quiz_id").join(q, "quiz_id")


def publishable(quizzes: DataFrame, questions: DataFrame, options: DataFrame, at: Column | None = None) -> DataFrame:
    """May each quiz be published; reason, question count, and the publish time: the first one where the quiz has
    been published before, ``at`` where it now may be, null where it may not.
    """
    at = F.current_timestamp() if at is None else at
    before = quizzes["published_at"] if "published_at" in quizzes.columns else F.lit(None).cast("timestamp")
    per_question = (options.groupBy("question_id")
                    .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("c")))
    per_quiz = (questions.select(F.col("id").alias("question_id"), "quiz_id").join(per_question, "question_id", "left")
                .groupBy("quiz_id").agg(
                    F.count(F.lit(1)).alias("question_count"),
                    F.count_if((F.coalesce("n", F.lit(0)) != 4) | (F.coalesce("c", F.lit(0)) != 1)).alias("invalid")))
    count = F.coalesce("question_count", F.lit(0))
    bad = F.coalesce("invalid", F.lit(0))
    return (quizzes.join(per_quiz, quizzes["id"] == per_quiz["quiz_id"], "left")
            .select(quizzes["id"].alias("quiz_id"), count.alias("question_count"), bad.alias("invalid_questions"),
                    F.when(count == 0, F.lit("quiz has no questions"))
                    .when(bad > 0, F.lit("question(s) without exactly 4 options and 1 correct answer")).alias("reason"), before.alias("published_at"))
            .withColumn("publishable", F.col("reason").isNull())
            .withColumn("published_at", F.coalesce("published_at", F.when(F.col("publishable"), at))))


def structural_issues(questions: DataFrame, options: DataFrame) -> DataFrame:
    """First structural defect of each question, null if none."""
    q = (questions.select(F.col("id").alias("question_id"), "question_text")
         .join(nested_options(options, "option_key", "option_text", "is_correct"), "question_id", "left"))
    opts = F.coalesce("options", F.expr("array()").cast(
        "array<struct<position:int,option_key:string,option_text:string,is_correct:boolean>>"))
    q = q.withColumn("options", opts)
    return q.select("question_id", question_issue(F.col("question_text"), F.col("options")).alias("issue"))


def question_issue(stem: Column, options: Column) -> Column:
    """The ordered structure rules on a stem and an array of option structs."""
    texts = F.transform(options, lambda o: norm_compare(o.option_text))
    return (F.when(F.length(strip(F.coalesce(stem, F.lit("")))) < 8, "question text is too short")
            .when(F.size(options) != 4, "question must have exactly 4 options")
            .when(F.size(F.filter(options, lambda o: o.is_correct)) != 1, "question must have exactly one correct option")
            .when(F.exists(texts, lambda x: x == ""), "option text is empty")
            .when(F.size(F.array_distinct(texts)) != 4, "question has duplicate options")
            .when(F.exists(options, lambda o: ~o.option_key.isin("A", "B", "C", "D")), "option key is not A-D"))


# The allowed domains of the learning tables, as (rule name, SQL condition that must not be false).
DOMAIN_RULES: dict[str, list[tuple[str, str]]] = {
    "documents": [("status", "status in ('UPLOADED','PROCESSING','READY','FAILED','ARCHIVED')"),
                  ("visibility", "visibility in ('PRIVATE','UNLISTED','PUBLIC')")],
    "quizzes": [("status", "status in ('DRAFT','PUBLISHED','ARCHIVED')"),
                ("visibility", "visibility in ('PRIVATE','UNLISTED','PUBLIC')"),
                ("difficulty", "difficulty in ('EASY','MEDIUM','HARD','MIXED')")],
    "questions": [("difficulty", "difficulty in ('EASY','MEDIUM','HARD')"), ("points", "points > 0")],
    "question_options": [("option_key", "option_key in ('A','B','C','D')"), ("position", "position between 1 and 4")],
    "quiz_attempts": [("status", "status in ('IN_PROGRESS','SUBMITTED','ABANDONED')"),
                      ("percentage", "percentage between 0 and 100")],
    "flashcard_reviews": [("rating", "rating between 0 and 3")],
    "messages": [("role", "role in ('SYSTEM','USER','ASSISTANT')")],
    "study_tasks": [("task_type", "task_type in ('STUDY','REVIEW','QUIZ','FLASHCARD')"),
                    ("status", "status in ('PENDING','IN_PROGRESS','COMPLETED','SKIPPED')")],
    "community_posts": [("one_resource", "(quiz_id is null) <> (flashcard_deck_id is null)")],
    "topic_mastery": [("mastery_score", "mastery_score between 0 and 100")],
}


def domain_violations(df: DataFrame, rules: list[tuple[str, str]], key: str = "id") -> DataFrame:
    """D3: one row per (row, broken rule); a null passes, as a CHECK does.  One scan for all rules."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(cond), F.lit(name)) for name, cond in rules]))
    return df.select(F.col(key).cast("string").alias("row_key"), F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def missing_references(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose reference is set but has no parent."""
    return (child.filter(F.col(column).isNotNull())
            .join(parent.select(F.col(parent_key).alias(column)), column, "left_anti"))


# Unique keys, and references (child, column, parent), of the learning tables.
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "chunks": [["document_id", "chunk_set_id", "chunk_index"]], "vectors": [["chunk_id", "embedding_model"]],
    "questions": [["quiz_id", "question_order"]], "options": [["question_id", "option_key"], ["question_id", "position"]],
    "answers": [["attempt_id", "question_id"]], "cards": [["deck_id", "card_order"]], "members": [["subject_id", "user_id"]],
    "messages": [["conversation_id", "turn"]],
}
REFERENCES: list[tuple[str, str, str]] = [
    ("documents", "subject_id", "subjects"), ("chunks", "document_id", "documents"), ("chunks", "section_id", "sections"),
    ("sections", "document_id", "documents"), ("vectors", "chunk_id", "chunks"), ("quizzes", "subject_id", "subjects"),
    ("questions", "quiz_id", "quizzes"), ("questions", "source_chunk_id", "chunks"), ("options", "question_id", "questions"),
    ("attempts", "quiz_id", "quizzes"), ("answers", "attempt_id", "attempts"), ("answers", "question_id", "questions"),
    ("answers", "selected_option_id", "options"), ("cards", "deck_id", "decks"), ("cards", "source_chunk_id", "chunks"),
    ("reviews", "flashcard_id", "cards"), ("posts", "quiz_id", "quizzes"), ("posts", "flashcard_deck_id", "decks"),
    ("members", "subject_id", "subjects"),
]


def key_violations(tables: Mapping[str, DataFrame], rules: Mapping[str, list[list[str]]] = UNIQUE_KEYS) -> DataFrame:
    """D4 for every table given: (table_name, rule, row_key, copies) of key values that occur more than once."""
    return _union([duplicate_keys(tables[name], keys).select(
        F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("rule"), F.concat_ws(":", *keys).alias("row_key"), "copies")
        for name, many in rules.items() if name in tables for keys in many])


def reference_violations(tables: Mapping[str, DataFrame], rules: list[tuple[str, str, str]] = REFERENCES) -> DataFrame:
    """D4 for every table given: (table_name, rule, reference, rows) of references without a parent, with the rows that hold them."""
    return _union([missing_references(tables[child], column, tables[parent].select("id").distinct())
                      .groupBy(F.col(column).cast("string").alias("reference")).agg(F.count(F.lit(1)).alias("rows"))
                      .select(F.lit(child).alias("table_name"), F.lit(column).alias("rule"), "reference", "rows")
                      for child, column, parent in rules if child in tables and parent in tables])


def chunk_set_issues(chunks: DataFrame, embeddings: DataFrame | None, heading_pattern: str) -> DataFrame:
    """Chunk sets that may not be switched on.

    More than one hard heading in a chunk; a chunk without an embedding (when embeddings are given);
    active rows different from the rows of the set while some row of it is active.
    """
    headings = chunks.filter(F.regexp_count("content", F.lit(heading_pattern)) > 1).select(
        "document_id", "chunk_set_id", F.col("id").alias("chunk_id"), F.lit("multiple hard headings").alias("issue"))
    parts = [headings]
    if embeddings is not None:
        have = embeddings.select(F.col("chunk_id").alias("id"))
        parts.append(chunks.join(have, "id", "left_anti").select(
            "document_id", "chunk_set_id", F.col("id").alias("chunk_id"), F.lit("missing embedding").alias("issue")))
    sets = (chunks.groupBy("document_id", "chunk_set_id")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_active").alias("active")))
    parts.append(sets.filter("active > 0 and active <> n").select(
        "document_id", "chunk_set_id", F.lit(None).cast("long").alias("chunk_id"),
        F.lit("active rows differ from set size").alias("issue")))
    return _union(parts)
