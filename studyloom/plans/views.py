"""Learning tables derived from the star-schema test tables by plain arithmetic.

Every view reads a whole table, so its size grows with the data.  ``ORACLE`` states the same
derivation in standard SQL for the result check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Learning:
    """Lazy access to the derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        try:
            build = VIEWS[name]
        except KeyError:
            raise AttributeError(name) from None
        return build(self)


def _users(t):
    return t.raw("customer").groupBy((_c("c_custkey div 10")).alias("id")).agg(_c("min(c_name)").alias("full_name"))


def _c(text):
    from pyspark.sql import functions as F
    return F.expr(text)


def _documents(t):
    return (t.raw("documents").groupBy(_c("doc_id div 50").alias("id")).agg(_c("count(1)").alias("n"))
            .selectExpr("id", "case when id % 16 = 15 then null else id div 2 end as subject_id",
                        "(id div 2) % 7 as owner_id", "concat('Document ', id) as original_name",
                        "case when id % 10 = 9 then 'PROCESSING' else 'READY' end as status",
                        "date_add(date'2024-01-01', cast(id % 30 as int)) as created_on"))


def _sections(t):
    return (t.raw("documents").groupBy(_c("doc_id div 25").alias("id")).agg(_c("count(1)").alias("n"))
            .selectExpr("id", "id div 2 as document_id",
                        "case when id % 8 = 7 then null else concat('Section ', id) end as title",
                        "cast(1 + id % 2 as int) as section_order"))


def _chunks(t):
    return t.raw("documents").selectExpr(
        "doc_id as id", "doc_id div 50 as document_id",
        "case when doc_id % 17 = 16 then null else doc_id div 25 end as section_id",
        "cast(doc_id % 50 as int) as chunk_index", "doc_id % 11 <> 10 as is_active",
        "case when doc_id % 11 = 10 then 'set-1' else 'set-2' end as chunk_set_id",
        "case when doc_id % 11 = 10 then 'v1' else 'v2' end as chunking_algorithm",
        "text as content", "lang", "n_chars as char_count")


def _quizzes(t):
    return (t.raw("orders").groupBy(_c("o_orderkey div 300").alias("id")).agg(_c("min(o_orderdate)").alias("created_at"))
            .selectExpr("id", "id % 7 as owner_id", "case when id % 10 = 9 then null else id div 5 end as subject_id",
                        "concat('Quiz ', id) as title",
                        "case id % 3 when 0 then 'DRAFT' when 1 then 'PUBLISHED' else 'ARCHIVED' end as status",
                        "case id % 4 when 0 then 'PRIVATE' when 1 then 'UNLISTED' else 'PUBLIC' end as visibility",
                        "created_at"))


def _attempts(t):
    return t.raw("orders").selectExpr(
        "o_orderkey as id", "o_orderkey div 300 as quiz_id", "o_custkey div 10 as user_id",
        "case when o_orderstatus = 'P' then 'IN_PROGRESS'"
        " when o_orderstatus = 'O' and o_orderkey % 9 = 0 then 'ABANDONED' else 'SUBMITTED' end as status",
        "o_orderdate - make_dt_interval(0, 0, 0, o_orderkey % 7200 - 60) as started_at",
        "o_orderdate as submitted_at")


def _answers(t):
    return (t.raw("lineitem").groupBy(_c("l_orderkey").alias("attempt_id"), _c("l_partkey").alias("question_id"))
            .agg(_c("min(l_returnflag)").alias("flag"))
            .selectExpr("attempt_id", "question_id",
                        "case flag when 'N' then true when 'R' then false end as is_correct",
                        "case flag when 'N' then question_id * 4 + question_id % 4"
                        " when 'R' then question_id * 4 + (question_id + 1) % 4 end as selected_option_id"))


def _answered(t):
    """Questions of attempts that have answers, some of them repeatedly: for those who need distinct rows of something else."""
    return t.raw("lineitem").selectExpr("l_orderkey as attempt_id", "l_partkey as question_id")


def _questions(t):
    return t.raw("part").selectExpr(
        "p_partkey as id", "p_partkey div 5 as quiz_id", "cast(p_partkey % 5 + 1 as int) as question_order",
        "case when p_partkey % 23 = 22 then null else p_partkey div 2 end as source_chunk_id",
        "concat(p_name, ' ', p_partkey) as question_text", "p_brand as explanation",
        "case p_size % 3 when 0 then 'EASY' when 1 then 'MEDIUM' else 'HARD' end as difficulty",
        "cast(1 + p_size % 3 as decimal(8,2)) as points", "p_size")


def _options(t):
    return (t.raw("part").selectExpr("p_partkey", "p_name", "p_size", "explode(sequence(0, 3)) as pos")
            .where("not (p_size = 50 and pos = 3)")
            .selectExpr("p_partkey * 4 + pos as id", "p_partkey as question_id", "substr('ABCD', pos + 1, 1) as option_key",
                        "case when p_size = 48 and pos = 2 then concat(upper(p_name), '  1.')"
                        " else concat(p_name, ' ', pos) end as option_text",
                        "pos = p_partkey % 4 or (p_size = 49 and pos = 0) as is_correct", "pos + 1 as position"))


def _reviews(t):
    return (t.raw("events").where("event_type <> 'signup'")
            .selectExpr("event_id as id", "user_id", "user_id * 10 + event_id % 10 as flashcard_id",
                        "cast(case event_type when 'error' then 0 when 'view' then 1 when 'click' then 2 else 3 end"
                        " as int) as rating", "ts as reviewed_at"))


def _cards(t):
    return t.raw("part").selectExpr("p_partkey as id", "p_partkey div 10 as deck_id", "p_partkey div 2 as source_chunk_id",
                                    "p_name as front_text", "p_brand as back_text",
                                    "cast(p_partkey % 10 + 1 as int) as card_order")


def _decks(t):
    return (t.raw("part").groupBy(_c("p_partkey div 10").alias("id")).agg(_c("min(p_name)").alias("title"))
            .selectExpr("id", "id as owner_id", "title",
                        "case id % 3 when 0 then 'PRIVATE' when 1 then 'UNLISTED' else 'PUBLIC' end as visibility"))


def _posts(t):
    return (t.raw("orders").groupBy(_c("o_orderkey div 100").alias("id"))
            .agg(_c("min(o_custkey div 10)").alias("owner_id"), _c("max(o_orderdate)").alias("published_at"))
            .selectExpr("id", "owner_id", "case when id % 2 = 0 then id div 3 end as quiz_id",
                        "case when id % 2 = 1 then id end as flashcard_deck_id", "concat('Post ', id) as title",
                        "case when id % 9 = 8 then 'HIDDEN' else 'PUBLISHED' end as status", "published_at"))


def _toggles(t):
    return (t.raw("events").where("event_type in ('click', 'view')")
            .selectExpr("event_id", "event_id div 67 as post_id", "user_id div 15 as user_id",
                        "case event_type when 'click' then 'LIKE' else 'SAVE' end as kind", "ts"))


def _notifications(t):
    return t.raw("events").selectExpr("event_id as id", "user_id", "event_type as notification_type",
                                      "get_json_object(props, '$.k') as title", "event_id % 3 = 0 as is_read",
                                      "ts as created_at")


def _messages(t):
    return t.raw("conversations").selectExpr("conv_id as conversation_id", "turn", "upper(role) as role",
                                             "text as content")


def _embeddings(t):
    return t.raw("embeddings").selectExpr("vec_id as chunk_id", "embedding", "size(embedding) as embedding_dimension",
                                          "'test' as embedding_model")


def _search_questions(t):
    return t.raw("benchmark").selectExpr(
        "item_id as question_id", "item_id % 7 as owner_id",
        "array_join(slice(split(text, ' '), 1, 3), ' ') as query")


def _subjects(t):
    return (t.documents.where("subject_id is not null").groupBy("subject_id", "owner_id")
            .agg(_c("min(created_on)").alias("updated_on"))
            .selectExpr("subject_id as id", "owner_id", "concat('Subject ', subject_id) as name", "updated_on"))


def _members(t):
    return (t.raw("customer").selectExpr("(c_custkey div 10) % 15 as user_id", "c_custkey div 150 as subject_id")
            .distinct())


def _plans(t):
    return t.subjects.selectExpr("id as plan_id", "owner_id as user_id", "id as subject_id",
                                 "date'2024-02-01' as start_date",
                                 "date_add(date'2024-02-01', cast(id % 6 as int)) as exam_date",
                                 "cast(10 + id * 7 % 90 as int) as daily_minutes")


VIEWS = {
    "users": _users, "documents": _documents, "sections": _sections, "chunks": _chunks, "quizzes": _quizzes,
    "attempts": _attempts, "answers": _answers, "answered": _answered, "questions": _questions, "options": _options,
    "reviews": _reviews, "cards": _cards, "decks": _decks, "posts": _posts, "toggles": _toggles,
    "notifications": _notifications, "messages": _messages, "vectors": _embeddings,
    "search_questions": _search_questions, "subjects": _subjects, "members": _members, "plans": _plans,
}

ORACLE: dict[str, tuple[tuple[str, ...], str]] = {
    "users": ((), "select c_custkey // 10 as id, min(c_name) as full_name from customer group by 1"),
    "ldocs": ((), """select id, case when id % 16 = 15 then null else id // 2 end as subject_id, (id // 2) % 7 as owner_id,
        'Document ' || id as original_name, case when id % 10 = 9 then 'PROCESSING' else 'READY' end as status,
        date '2024-01-01' + cast(id % 30 as integer) as created_on
        from (select distinct doc_id // 50 as id from documents)"""),
    "sections": ((), """select id, id // 2 as document_id, case when id % 8 = 7 then null else 'Section ' || id end as title,
        cast(1 + id % 2 as integer) as section_order from (select distinct doc_id // 25 as id from documents)"""),
    "chunks": ((), """select doc_id as id, doc_id // 50 as document_id,
        case when doc_id % 17 = 16 then null else doc_id // 25 end as section_id,
        cast(doc_id % 50 as integer) as chunk_index, doc_id % 11 <> 10 as is_active,
        case when doc_id % 11 = 10 then 'set-1' else 'set-2' end as chunk_set_id,
        case when doc_id % 11 = 10 then 'v1' else 'v2' end as chunking_algorithm,
        text as content, lang, n_chars as char_count from documents"""),
    "quizzes": ((), """select id, id % 7 as owner_id, case when id % 10 = 9 then null else id // 5 end as subject_id,
        'Quiz ' || id as title, case id % 3 when 0 then 'DRAFT' when 1 then 'PUBLISHED' else 'ARCHIVED' end as status,
        case id % 4 when 0 then 'PRIVATE' when 1 then 'UNLISTED' else 'PUBLIC' end as visibility, created_at
        from (select o_orderkey // 300 as id, min(o_orderdate) as created_at from orders group by 1)"""),
    "attempts": ((), """select o_orderkey as id, o_orderkey // 300 as quiz_id, o_custkey // 10 as user_id,
        case when o_orderstatus = 'P' then 'IN_PROGRESS' when o_orderstatus = 'O' and o_orderkey % 9 = 0 then 'ABANDONED'
        else 'SUBMITTED' end as status, o_orderdate - to_seconds(o_orderkey % 7200 - 60) as started_at,
        o_orderdate as submitted_at from orders"""),
    "answers": ((), """select attempt_id, question_id, case flag when 'N' then true when 'R' then false end as is_correct,
        case flag when 'N' then question_id * 4 + question_id % 4 when 'R' then question_id * 4 + (question_id + 1) % 4 end
        as selected_option_id from (select l_orderkey as attempt_id, l_partkey as question_id, min(l_returnflag) as flag
        from lineitem group by 1, 2)"""),
    "questions": ((), """select p_partkey as id, p_partkey // 5 as quiz_id, cast(p_partkey % 5 + 1 as integer) as question_order,
        case when p_partkey % 23 = 22 then null else p_partkey // 2 end as source_chunk_id,
        p_name || ' ' || p_partkey as question_text, p_brand as explanation,
        case p_size % 3 when 0 then 'EASY' when 1 then 'MEDIUM' else 'HARD' end as difficulty,
        cast(1 + p_size % 3 as decimal(8,2)) as points, p_size from part"""),
    "options": ((), """select p_partkey * 4 + pos as id, p_partkey as question_id, substr('ABCD', pos + 1, 1) as option_key,
        case when p_size = 48 and pos = 2 then upper(p_name) || '  1.' else p_name || ' ' || pos end as option_text,
        pos = p_partkey % 4 or (p_size = 49 and pos = 0) as is_correct, pos + 1 as position
        from part, (select cast(unnest(range(4)) as integer) as pos) where not (p_size = 50 and pos = 3)"""),
    "reviews": ((), """select event_id as id, user_id, user_id * 10 + event_id % 10 as flashcard_id,
        case event_type when 'error' then 0 when 'view' then 1 when 'click' then 2 else 3 end as rating, ts as reviewed_at
        from events where event_type <> 'signup'"""),
    "cards": ((), """select p_partkey as id, p_partkey // 10 as deck_id, p_partkey // 2 as source_chunk_id,
        p_name as front_text, p_brand as back_text, cast(p_partkey % 10 + 1 as integer) as card_order from part"""),
    "decks": ((), """select id, id as owner_id, title,
        case id % 3 when 0 then 'PRIVATE' when 1 then 'UNLISTED' else 'PUBLIC' end as visibility
        from (select p_partkey // 10 as id, min(p_name) as title from part group by 1)"""),
    "posts": ((), """select id, owner_id, case when id % 2 = 0 then id // 3 end as quiz_id,
        case when id % 2 = 1 then id end as flashcard_deck_id, 'Post ' || id as title,
        case when id % 9 = 8 then 'HIDDEN' else 'PUBLISHED' end as status, published_at
        from (select o_orderkey // 100 as id, min(o_custkey // 10) as owner_id, max(o_orderdate) as published_at
        from orders group by 1)"""),
    "toggles": ((), """select event_id, event_id // 67 as post_id, user_id // 15 as user_id,
        case event_type when 'click' then 'LIKE' else 'SAVE' end as kind, ts from events
        where event_type in ('click', 'view')"""),
    "notifications": ((), """select event_id as id, user_id, event_type as notification_type,
        json_extract_string(props, '$.k') as title, event_id % 3 = 0 as is_read, ts as created_at from events"""),
    "messages": ((), "select conv_id as conversation_id, turn, upper(role) as role, text as content from conversations"),
    "vectors": ((), """select vec_id as chunk_id, embedding, len(embedding) as embedding_dimension from embeddings"""),
    "search_questions": ((), """select item_id as question_id, item_id % 7 as owner_id,
        array_to_string(string_split(text, ' ')[1:3], ' ') as query from benchmark"""),
    "subjects": (("ldocs",), """select subject_id as id, owner_id, 'Subject ' || subject_id as name,
        min(created_on) as updated_on from ldocs where subject_id is not null group by 1, 2"""),
    "members": ((), "select distinct (c_custkey // 10) % 15 as user_id, c_custkey // 150 as subject_id from customer"),
    "plans": (("subjects",), """select id as plan_id, owner_id as user_id, id as subject_id, date '2024-02-01' as start_date,
        date '2024-02-01' + cast(id % 6 as integer) as exam_date, cast(10 + id * 7 % 90 as integer) as daily_minutes
        from subjects"""),
}


def oracle(names: str, body: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """``body`` preceded by the derivations it needs."""
    known = {**ORACLE, **(extra or {})}
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, sql = known[name]
        for n in needs:
            add(n)
        done[name] = sql

    for n in names.split():
        add(n)
    head = ", ".join(f"{n} as ({sql})" for n, sql in done.items())
    return (f"with {head} " if head else "") + body
