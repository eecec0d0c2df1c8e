"""Queries on access, data quality, listings and id sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions.text import norm_compare
from studyloom.operators import access, lists, planning
from studyloom.operators.chunking import HEADING_START
from studyloom.plans.registry import query
from studyloom.plans.views import oracle
from studyloom.sources import files, sinks
from studyloom.operators.learning import study_units


# ------------------------------------------------------------------------------------ P1-P4
def scope(t):
    """One request per learning document: by list (its own and the next document), by subject, or by owner."""
    return t.documents.selectExpr(
        "id as request_id", "owner_id", "case when id % 3 = 1 then subject_id end as subject_id",
        "case when id % 3 = 0 then array(id, id + 1, id) end as document_ids")


SCOPE = {"scope_": (("ldocs",), """select id as request_id, owner_id, case when id % 3 = 1 then subject_id end as subject_id,
      case when id % 3 = 0 then [id, id + 1, id] end as document_ids from ldocs"""),
    "pairs": (("scope_", "ldocs"), """select s.request_id, d.id as document_id from scope_ s join ldocs d on d.owner_id = s.owner_id and d.status = 'READY'
      where case when len(s.document_ids) > 0 then list_contains(s.document_ids, d.id) else s.subject_id is null or d.subject_id = s.subject_id end""")}


@query("usable_chunks", oracle("pairs chunks", """select p.request_id, c.document_id, c.id from pairs p join chunks c on c.document_id = p.document_id
    where c.is_active""", SCOPE))
def usable_chunks(t):
    return access.usable_chunks(t.chunks, t.documents, scope(t)).select("request_id", "document_id", "id")


@query("subject_check", oracle("attempts subjects", """select a.id as request_id, a.user_id as owner_id, a.quiz_id % 12 as subject_id, 'Subject not found' as reason
    from attempts a where not exists (select 1 from subjects s where s.id = a.quiz_id % 12 and s.owner_id = a.user_id)"""))
def subject_check(t):
    reqs = t.attempts.selectExpr("id as request_id", "user_id as owner_id", "quiz_id % 12 as subject_id")
    return access.check_subject(reqs, t.subjects)


DOCREQ = {"reqs": ((), """select o_orderkey as request_id, (o_orderkey // 7) % 7 as owner_id, case when o_orderkey % 2 = 0 then (o_orderkey // 7) % 7 end as subject_id,
      [o_orderkey % 20, ((o_orderkey // 7) % 7) * 2, ((o_orderkey // 7) % 7) * 2] as document_ids,
      [o_orderkey % 1000, o_orderkey % 7] as chunk_ids from orders"""),
    "docitems": (("reqs",), "select distinct request_id, owner_id, subject_id, unnest(document_ids) as document_id from reqs"),
    "chunkitems": (("reqs",), "select distinct request_id, owner_id, subject_id, document_ids, unnest(chunk_ids) as chunk_id from reqs")}


def id_requests(t):
    return t.raw("orders").selectExpr(
        "o_orderkey as request_id", "(o_orderkey div 7) % 7 as owner_id",
        "case when o_orderkey % 2 = 0 then (o_orderkey div 7) % 7 end as subject_id",
        "array(o_orderkey % 20, ((o_orderkey div 7) % 7) * 2, ((o_orderkey div 7) % 7) * 2) as document_ids",
        "array(o_orderkey % 1000, o_orderkey % 7) as chunk_ids")


@query("document_check", oracle("docitems ldocs", """select i.request_id, count(*) as requested, count(d.id) as accessible, count(*) = count(d.id) as ok
    from docitems i left join ldocs d on d.id = i.document_id and d.owner_id = i.owner_id and (i.subject_id is null or d.subject_id = i.subject_id)
    group by 1""", DOCREQ))
def document_check(t):
    return access.check_documents(id_requests(t), t.documents)


@query("chunk_check", oracle("chunkitems ldocs chunks", """select i.request_id, count(*) as requested, count(d.id) as accessible, count(*) = count(d.id) as ok
    from chunkitems i left join chunks c on c.id = i.chunk_id and c.is_active and list_contains(i.document_ids, c.document_id)
    left join ldocs d on d.id = c.document_id and d.owner_id = i.owner_id and (i.subject_id is null or d.subject_id = i.subject_id)
    group by 1""", DOCREQ))
def chunk_check(t):
    return access.check_chunks(id_requests(t), t.chunks, t.documents)


# ------------------------------------------------------------------------------------ P5-P8
VIEWERS = {"opened": (("attempts", "quizzes"), """select distinct a.user_id % 9 as user_id, a.quiz_id, z.owner_id, z.title from attempts a join quizzes z on z.id = a.quiz_id
    where z.owner_id = a.user_id % 9 or (z.status = 'PUBLISHED' and z.visibility in ('PUBLIC', 'UNLISTED'))""")}


def viewers(t):
    return t.attempts.selectExpr("user_id % 9 as user_id", "quiz_id").distinct()


@query("visible_quizzes", oracle("opened", "select user_id, quiz_id, title from opened", VIEWERS))
def visible_quizzes(t):
    return access.visible_quizzes(viewers(t), t.quizzes).select("user_id", "quiz_id", "title")


@query("visible_decks", oracle("reviews decks", """select distinct r.user_id, d.id as deck_id, d.title from reviews r join decks d on d.id = (r.user_id + r.id) % 150
    where d.owner_id = r.user_id or d.visibility in ('PUBLIC', 'UNLISTED')"""))
def visible_decks(t):
    reqs = t.reviews.selectExpr("user_id", "(user_id + id) % 150 as deck_id").distinct()
    return access.visible_decks(reqs, t.decks).select("user_id", "deck_id", "title")


def _flat(df, *extra):
    text = F.array_join(F.transform("options", lambda o: F.concat_ws(
        "|", o.position.cast("string"), o.option_key, o.option_text, *[o[e].cast("string") for e in extra])), ";")
    return df.withColumn("options", text)


@query("quiz_view", oracle("opened questions options", """select v.user_id, v.quiz_id, q.id as question_id, q.question_order, q.question_text,
    case when v.owner_id = v.user_id then q.explanation end as explanation, case when v.owner_id = v.user_id then q.source_chunk_id end as source_chunk_id,
    (select string_agg(o.position || '|' || o.option_key || '|' || o.option_text || case when v.owner_id = v.user_id then '|' || o.is_correct else '' end, ';'
      order by o.position) from options o where o.question_id = q.id) as options
    from opened v join questions q on q.quiz_id = v.quiz_id""", VIEWERS))
def quiz_view(t):
    return _flat(access.quiz_view(viewers(t), t.quizzes, t.questions, t.options), "is_correct")


@query("attempt_sheet", oracle("attempts questions options", """, o as (select question_id, string_agg(position || '|' || option_key || '|' || option_text, ';' order by position) as options
    from options group by 1) select a.id as attempt_id, a.quiz_id, q.id as question_id, q.question_order, q.question_text, o.options
    from attempts a join questions q on q.quiz_id = a.quiz_id left join o on o.question_id = q.id where a.status = 'IN_PROGRESS'"""))
def attempt_sheet(t):
    return _flat(access.attempt_sheet(t.attempts.filter("status = 'IN_PROGRESS'"), t.questions, t.options))


# ------------------------------------------------------------------------------------ D1-D5
@query("publishable_quizzes", oracle("quizzes questions options", """, pq as (select q.id, q.quiz_id, count(o.id) as n, count(*) filter (where o.is_correct) as c
    from questions q left join options o on o.question_id = q.id group by 1, 2),
    z as (select quiz_id, count(*) as question_count, count(*) filter (where n <> 4 or c <> 1) as invalid from pq group by 1)
    select k.id as quiz_id, coalesce(z.question_count, 0) as question_count, coalesce(z.invalid, 0) as invalid_questions,
      case when z.question_count is null then 'quiz has no questions' when z.invalid > 0 then 'question(s) without exactly 4 options and 1 correct answer' end as reason,
      coalesce(z.invalid, 1) = 0 as publishable, case when k.status = 'PUBLISHED' then k.created_at when coalesce(z.invalid, 1) = 0 then timestamp '2024-05-01 08:00:00' end as published_at
    from quizzes k left join z on z.quiz_id = k.id"""))
def publishable_quizzes(t):
    known = t.quizzes.withColumn("published_at", F.when(F.col("status") == "PUBLISHED", F.col("created_at")))
    return access.publishable(known, t.questions, t.options, F.lit("2024-05-01 08:00:00").cast(known.schema["published_at"].dataType))


@query("structural_issues", oracle("questions options", """, o as (select question_id, count(*) as n, count(*) filter (where is_correct) as c,
      count(distinct k) as d, count(*) filter (where k = '') as e from (select *, regexp_replace(regexp_replace(lower(trim(option_text)), '\\s+', ' ', 'g'), '[.!?;,:\\-]+$', '') as k from options) group by 1)
    select q.id as question_id, case when length(trim(q.question_text)) < 8 then 'question text is too short' when coalesce(n, 0) <> 4 then 'question must have exactly 4 options'
      when c <> 1 then 'question must have exactly one correct option' when e > 0 then 'option text is empty' when d <> 4 then 'question has duplicate options' end as issue
    from questions q left join o on o.question_id = q.id"""))
def structural_issues(t):
    return access.structural_issues(t.questions, t.options)


@query("domain_violations", """select cast(o_orderkey as varchar) as row_key, 'status' as rule from orders where o_orderstatus = 'P' union all
    select cast(o_orderkey as varchar), 'percentage' from orders where o_totalprice / 4000.0 > 100 union all
    select 'm' || conv_id || '-' || turn, 'role' from conversations where upper(role) not in ('USER', 'ASSISTANT')""")
def domain_violations(t):
    """Raw order states and prices read as attempt states and percentages; messages of the system role are foreign here."""
    attempts = t.raw("orders").selectExpr("o_orderkey as id", "case o_orderstatus when 'F' then 'SUBMITTED' when 'O' then 'IN_PROGRESS'"
                                          " else o_orderstatus end as status", "o_totalprice / 4000.0 as percentage")
    messages = t.raw("conversations").selectExpr("concat('m', conv_id, '-', turn) as id", "upper(role) as role")
    return access.domain_violations(attempts, access.DOMAIN_RULES["quiz_attempts"]).unionByName(
        access.domain_violations(messages, [("role", "role in ('USER','ASSISTANT')")]))


@query("duplicate_keys", "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(t):
    return access.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("missing_references", oracle("posts quizzes", """select p.id, p.quiz_id from posts p where p.quiz_id is not null
    and p.quiz_id not in (select id from quizzes where status <> 'ARCHIVED')"""))
def missing_references(t):
    return access.missing_references(t.posts, "quiz_id", t.quizzes.filter("status <> 'ARCHIVED'")).select("id", "quiz_id")


@query("key_violations", oracle("chunks vectors questions options cards messages", """select 'questions' as table_name, 'quiz_id,question_order' as rule, quiz_id || ':' || question_order as row_key, count(*) as copies
    from questions group by quiz_id, question_order having count(*) > 1 union all
    select 'cards', 'deck_id,card_order', deck_id || ':' || card_order, count(*) from cards group by deck_id, card_order having count(*) > 1 union all
    select 'options', 'question_id,option_key', question_id || ':' || option_key, count(*) from options group by question_id, option_key having count(*) > 1 union all
    select 'options', 'question_id,position', question_id || ':' || position, count(*) from options group by question_id, position having count(*) > 1 union all
    select 'chunks', 'document_id,chunk_set_id,chunk_index', document_id || ':' || chunk_set_id || ':' || chunk_index, count(*) from chunks group by document_id, chunk_set_id, chunk_index having count(*) > 1 union all
    select 'vectors', 'chunk_id', cast(chunk_id as varchar), count(*) from vectors group by chunk_id having count(*) > 1 union all
    select 'messages', 'role', role, count(*) from messages group by role having count(*) > 1"""))
def key_violations(t):
    """The unique keys of the mapped tables; the role of a message stands for a key that is broken."""
    rules = {k: access.UNIQUE_KEYS[k] for k in ("questions", "cards", "options", "chunks")} | {"vectors": [["chunk_id"]], "messages": [["role"]]}
    return access.key_violations({k: getattr(t, k) for k in rules}, rules)


@query("reference_violations", oracle("posts quizzes questions cards chunks reviews answers attempts", """select 'posts' as table_name, 'quiz_id' as rule, cast(quiz_id as varchar) as reference, count(*) as rows from posts where quiz_id is not null
      and quiz_id not in (select id from quizzes) group by quiz_id union all
    select 'questions', 'quiz_id', cast(quiz_id as varchar), count(*) from questions where quiz_id not in (select id from quizzes) group by quiz_id union all
    select 'questions', 'source_chunk_id', cast(source_chunk_id as varchar), count(*) from questions where source_chunk_id is not null and source_chunk_id not in (select id from chunks) group by source_chunk_id union all
    select 'cards', 'source_chunk_id', cast(source_chunk_id as varchar), count(*) from cards where source_chunk_id not in (select id from chunks) group by source_chunk_id union all
    select 'reviews', 'flashcard_id', cast(flashcard_id as varchar), count(*) from reviews where flashcard_id not in (select id from cards) group by flashcard_id union all
    select 'attempts', 'quiz_id', cast(quiz_id as varchar), count(*) from attempts where quiz_id not in (select id from quizzes) group by quiz_id union all
    select 'answers', 'question_id', cast(question_id as varchar), count(*) from answers where question_id not in (select id from questions) group by question_id"""))
def reference_violations(t):
    """The references between the mapped tables."""
    held = ("posts", "quizzes", "questions", "cards", "chunks", "reviews", "answers", "attempts")
    kept = {("posts", "quiz_id"), ("questions", "quiz_id"), ("questions", "source_chunk_id"), ("cards", "source_chunk_id"), ("reviews", "flashcard_id"), ("attempts", "quiz_id"), ("answers", "question_id")}
    return access.reference_violations({k: getattr(t, k) for k in held}, [r for r in access.REFERENCES if r[:2] in kept])


@query("chunk_set_issues", oracle("chunks vectors", """select document_id, chunk_set_id, id as chunk_id, 'missing embedding' as issue from chunks
    where id not in (select chunk_id from vectors) union all
    select document_id, s, null, 'active rows differ from set size' from (select document_id, 'set-' || (id % 11 // 6) as s, count(*) as n, count(*) filter (where is_active) as a from chunks group by 1, 2)
    where a > 0 and a <> n union all
    select document_id, chunk_set_id, id, 'multiple hard headings' from chunks where len(regexp_extract_all(content, '(?im)^\\s*(?:CHƯƠNG|CHUONG|CHAPTER|PHẦN|PHAN|PART)\\s+(?:\\d+|[IVXLCDM]+)')) > 1""").replace(
    "document_id, chunk_set_id, id", "document_id, 'set-' || (id % 11 // 6) as chunk_set_id, id"))
def chunk_set_issues(t):
    """Two sets a document: one is whole, the other has superseded rows."""
    return access.chunk_set_issues(t.chunks.withColumn("chunk_set_id", F.expr("concat('set-', id % 11 div 6)")), t.vectors, HEADING_START)


# ------------------------------------------------------------------------------------ S2, S4, S5, S7, S8
@query("upload_register", """select 'doc' || doc_id || case doc_id % 5 when 0 then '.PDF' when 1 then '.txt' when 2 then '.md' when 3 then '.docx' else '.exe' end as original_name,
    ['pdf', 'txt', 'md', 'docx', 'exe'][1 + doc_id % 5] as file_extension, cast(octet_length(encode(text)) as bigint) as file_size_bytes,
    case when doc_id % 5 <> 4 then sha256(text) end as checksum_sha256, case when doc_id % 5 = 4 then 'unsupported file type: exe' when octet_length(encode(text)) > 31457280 then 'file exceeds 30 MB' end as reason,
    case when doc_id % 5 <> 4 then substr(sha256('/up/doc' || doc_id || case doc_id % 5 when 0 then '.PDF' when 1 then '.txt' when 2 then '.md' else '.docx' end || ':' || sha256(text)), 1, 32)
      || '_doc' || doc_id || case doc_id % 5 when 0 then '.PDF' when 1 then '.txt' when 2 then '.md' else '.docx' end end as stored_name
    from documents""")
def upload_register(t):
    """Documents as uploaded files."""
    up = t.raw("documents").select(
        F.concat(F.lit("/up/doc"), "doc_id", F.expr("case doc_id % 5 when 0 then '.PDF' when 1 then '.txt' when 2 then '.md' when 3 then '.docx' else '.exe' end")).alias("path"),
        F.col("text").cast("binary").alias("content")).withColumn("length", F.length("content").cast("long"))
    return files.register_files(up).select("original_name", "file_extension", "file_size_bytes", "checksum_sha256", "stored_name", "reason")


@query("embedding_load", """select vec_id as chunk_id, cast(len(embedding) as integer) as embedding_dimension,
    round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total from embeddings""")
def embedding_load(t):
    """Vectors written as JSON and read back."""
    text = files.embeddings_to_json(t.vectors).select("chunk_id", "embedding_model", "embedding_json")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return files.load_embeddings(text).select("chunk_id", "embedding_dimension", F.round(total, 4).alias("total"))


@query("published_chunk_sets", oracle("chunks", """, touched as (select distinct document_id from chunks where chunk_set_id = 'set-1')
    select id, document_id, chunk_set_id, case when chunk_set_id = 'set-1' then true else is_active and document_id not in (select document_id from touched) end as is_active,
      chunk_set_id = 'set-2' and is_active and document_id in (select document_id from touched) as superseded from chunks"""))
def published_chunk_sets(t):
    rows = t.chunks.withColumn("superseded_at", F.lit(None).cast("timestamp_ntz")).select(
        "id", "document_id", "chunk_set_id", "is_active", "superseded_at")
    out = sinks.publish_chunk_set(rows.filter("chunk_set_id = 'set-1'"), rows.filter("chunk_set_id = 'set-2'"),
                                  F.lit("2024-03-01").cast("timestamp_ntz"))
    return out.withColumn("superseded", F.col("superseded_at").isNotNull()).drop("superseded_at")


@query("quiz_listing", oracle("questions options", """, o as (select question_id, list('  ' || option_key || '. ' || option_text || case when is_correct then ' *' else '' end order by position) as l
    from options group by 1), b as (select q.quiz_id, q.question_order, list_concat(['Câu ' || q.question_order || ': ' || q.question_text], o.l, ['  Giải thích: ' || q.explanation], ['']) as l
    from questions q join o on o.question_id = q.id)
    select 'QUIZ' as resource_type, quiz_id as resource_id, question_order, cast(unnest(range(len(l))) as integer) as part_no, unnest(l) as line from b"""))
def quiz_listing(t):
    return sinks.quiz_lines(t.questions, t.options)


@query("deck_listing", oracle("cards", """select 'FLASHCARD_DECK' as resource_type, deck_id as resource_id, card_order,
    card_order || '. ' || front_text || chr(10) || '   → ' || back_text as line from cards"""))
def deck_listing(t):
    return sinks.deck_lines(t.cards)


from studyloom.plans.learning_queries import UNITS  # noqa: E402


@query("plan_listing", oracle("tasks", """select 'STUDY_PLAN' as resource_type, plan_id as resource_id, task_date, sort_order,
    task_date || ': [' || task_type || '] ' || title || ' (' || estimated_minutes || ' phút)' as line from tasks""", UNITS))
def plan_listing(t):
    return sinks.plan_lines(planning.study_plan(t.plans, study_units(t.documents, t.sections)))


def quiz_payloads(t):
    opts = t.options.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", "option_key", "option_text", "is_correct"))).alias("options"))
    q = t.questions.withColumnRenamed("id", "question_id").join(opts, "question_id")
    return q.groupBy(F.col("quiz_id").alias("payload_id")).agg(
        F.array_sort(F.collect_list(F.struct("question_order", "question_text", "difficulty", "explanation", "points", "source_chunk_id",
                                             "options"))).alias("questions"),
        F.collect_list("source_chunk_id").alias("document_ids"))


@query("payload_questions", oracle("questions options", """select quiz_id as payload_id, quiz_id || ':' || rn as question_key, rn as question_order, question_text, source_chunk_id
    from (select *, cast(row_number() over (partition by quiz_id order by question_order) as integer) as rn from questions
    where id in (select question_id from options))"""))
def payload_questions(t):
    return files.normalize_quizzes(quiz_payloads(t))["questions"].select("payload_id", "question_key", "question_order", "question_text", "source_chunk_id")


@query("payload_options", oracle("questions options", """select q.quiz_id || ':' || q.question_order as question_key, o.option_key, o.option_text, o.is_correct, o.position
    from questions q join options o on o.question_id = q.id"""))
def payload_options(t):
    return files.normalize_quizzes(quiz_payloads(t))["options"]


@query("payload_cards", oracle("cards", "select deck_id as payload_id, card_order, front_text, back_text, source_chunk_id from cards"))
def payload_cards(t):
    nested = t.cards.groupBy(F.col("deck_id").alias("payload_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("card_order", "front_text", "back_text", "source_chunk_id"))),
                    lambda c: F.struct(c.front_text.alias("front_text"), c.back_text.alias("back_text"),
                                       c.source_chunk_id.alias("source_chunk_id"))).alias("cards"),
        F.array().cast("array<long>").alias("document_ids"))
    return files.normalize_decks(nested)["cards"]


# ------------------------------------------------------------------------------------ U-1, U-2, U-4
@query("distinct_id_lists", """select o_orderkey as request_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(l, lambda x: [list_position(l, x), x]))), lambda y: y[2]), ',') as ids
    from (select o_orderkey, [o_custkey % 5, o_orderkey % 4, o_custkey % 3, o_orderkey % 4] as l from orders)""")
def distinct_id_lists(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("request_id"), F.array_join(lists.distinct_ordered(
        F.expr("array(o_custkey % 5, o_orderkey % 4, o_custkey % 3, o_orderkey % 4)")).cast("array<string>"), ",").alias("ids"))


@query("same_id_sets", oracle("answers", """, a as (select distinct attempt_id, question_id % 3 as k from answers where is_correct),
    b as (select distinct attempt_id, question_id % 3 as k from answers where not is_correct)
    select attempt_id, count(*) = count(ak) and count(*) = count(bk) as same from (select coalesce(a.attempt_id, b.attempt_id) as attempt_id, a.k as ak, b.k as bk
      from a full join b on a.attempt_id = b.attempt_id and a.k = b.k) group by 1"""))
def same_id_sets(t):
    rows = t.answers.withColumn("k", F.expr("question_id % 3"))
    return lists.same_set(rows.filter("is_correct"), rows.filter("not is_correct"), "attempt_id", "k")


@query("missing_slots", oracle("attempts questions answers", """select a.id as request_id, q.id as slot from attempts a join questions q on q.quiz_id = a.quiz_id
    where not exists (select 1 from answers x where x.attempt_id = a.id and x.question_id = q.id)"""))
def missing_slots(t):
    expected = t.attempts.selectExpr("id as request_id", "quiz_id").join(t.questions.selectExpr("quiz_id", "id as slot"), "quiz_id")
    return lists.missing_slots(expected.select("request_id", "slot"), t.answers.selectExpr("attempt_id as request_id", "question_id as slot"))
