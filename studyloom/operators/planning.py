"""Practice ranking, spaced plans, study plans and quiz source selection (W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from studyloom.functions.mastery import (due_status, interval_days, practice_rank, practice_reason, priority,
                                         spacing_reason)
from studyloom.functions.text import norm_compare, strip
from studyloom.operators.numbering import numbered, top_per_key

KEY = ["user_id", "subject_id"]


def _weakness_order() -> list[Column]:
    return [F.asc("mastery_score"), F.desc("attempts"), F.asc("section_id")]


def recommend(topics: DataFrame) -> DataFrame:
    """Rank every topic that is not STRONG.

    WEAK, then DEVELOPING, both by mastery, more attempts, section; then NOT_ENOUGH_DATA by fewer
    attempts, section.  A key holds the sections of one subject, so one window per key serves the ranks and the
    number of skipped STRONG topics; no row is read twice.
    """
    ranked = topics.withColumn("_p", practice_rank(F.col("status")))
    unsure = F.col("status") == "NOT_ENOUGH_DATA"
    first = F.when(unsure, F.col("attempts").cast("double")).otherwise(F.col("mastery_score"))
    second = F.when(unsure, F.lit(0)).otherwise(-F.col("attempts"))
    rows = ranked.withColumns({
        "skipped_strong_topics": F.count_if(F.col("status") == "STRONG").over(W.partitionBy(*KEY)),
        "rank": F.row_number().over(W.partitionBy(*KEY).orderBy("_p", first, second, "section_id")).cast("long")})
    return (rows.filter(F.col("_p") < 999).drop("_p")
            .withColumn("reason", practice_reason(F.col("status"), F.col("mastery_score"), F.col("attempts"))))


def weak_topics(topics: DataFrame) -> DataFrame:
    """WEAK topics, weakest first."""
    return numbered(topics.filter("status = 'WEAK'"), KEY, [F.floor("mastery_score")], _weakness_order(), "rank")


def spaced_items(topics: DataFrame, as_of: Column) -> DataFrame:
    """Next review, due status, priority and day of every topic."""
    never = F.col("last_practiced_at").isNull()
    t = topics.withColumn("interval_days", interval_days(F.col("status"), F.col("mastery_score"), F.col("attempts")))
    t = t.withColumn("next_review_at", F.when(never, as_of).otherwise(
        F.expr("last_practiced_at + make_dt_interval(interval_days, 0, 0, 0)")))
    nxt = F.col("next_review_at")
    return t.withColumns({
        "due_status": due_status(as_of, nxt, never),
        "priority_score": priority(F.col("status"), F.col("mastery_score"), F.col("attempts"), nxt, as_of),
        "scheduled_date": F.greatest(F.to_date(as_of), F.to_date(nxt)),
        "is_due": nxt <= as_of,
        "reason": spacing_reason(F.col("status"), F.col("mastery_score"), F.col("attempts"), F.col("interval_days"))})


def spaced_plan(topics: DataFrame, as_of: Column, horizon: int = 7) -> DataFrame:
    """Topics placed on days, highest priority first; later ones are left out (see ``plan_totals``)."""
    if not 1 <= horizon <= 90:
        raise ValueError("horizon must be between 1 and 90 days")
    kept = spaced_items(topics, as_of).filter(F.col("scheduled_date") <= F.date_add(F.to_date(as_of), horizon - 1))
    w = W.partitionBy(*KEY, "scheduled_date").orderBy(F.desc("priority_score"), F.asc("section_id"))
    return kept.withColumn("day_rank", F.row_number().over(w).cast("long"))


def plan_calendar(topics: DataFrame, as_of: Column, horizon: int = 7) -> DataFrame:
    """Every day of the horizon per scope with its item count; empty days are kept.

    All days of a scope are counted in one pass over the topics, so rows of days are made after the last shuffle.  A scope without a user
    or a subject has its days, and no items on them.
    """
    dates = [F.date_add(F.to_date(as_of), n) for n in range(horizon)]
    known = F.col("user_id").isNotNull() & F.col("subject_id").isNotNull()
    counts = spaced_items(topics, as_of).groupBy(*KEY).agg(
        *[F.count_if(known & (F.col("scheduled_date") == date)).alias(f"_{n}") for n, date in enumerate(dates)])
    return counts.select(*KEY, F.inline(F.array(*[
        F.struct(date.alias("scheduled_date"), F.col(f"_{n}").alias("item_count")) for n, date in enumerate(dates)])))


def plan_totals(topics: DataFrame, as_of: Column, horizon: int = 7) -> DataFrame:
    """Topics in all, scheduled, due and deferred per scope."""
    inside = F.col("scheduled_date") <= F.date_add(F.to_date(as_of), horizon - 1)
    return spaced_items(topics, as_of).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total_topics"), F.count_if(inside).alias("scheduled_topics"),
        F.count_if("is_due").alias("due_topics"), F.count_if(~inside).alias("deferred_topics"))


def due_sections(topics: DataFrame, as_of: Column, question_count: Column) -> DataFrame:
    """Sections due now, highest priority first, at most one per wanted question (``question_count`` >= 1)."""
    due = spaced_items(topics, as_of).filter("is_due").withColumn("_n", F.greatest(F.lit(1), question_count))
    return _first_n(due, [F.desc("priority_score"), F.asc("section_id")])


def adaptive_sections(topics: DataFrame, question_count: Column) -> DataFrame:
    """The first ``question_count`` recommended sections.  Ranks only what is kept."""
    unsure = F.col("status") == "NOT_ENOUGH_DATA"
    rows = (topics.withColumn("_p", practice_rank(F.col("status"))).filter("_p < 999")
            .withColumn("_n", F.greatest(F.lit(1), question_count)))
    first = F.when(unsure, F.col("attempts").cast("double")).otherwise(F.col("mastery_score"))
    second = F.when(unsure, F.lit(0)).otherwise(-F.col("attempts"))
    return _first_n(rows, [F.col("_p"), first, second, F.col("section_id")]).drop("_p")


def _first_n(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The first ``_n`` rows per key, whatever that number is; a key holds the sections of one subject."""
    return rows.withColumn("pick", F.row_number().over(W.partitionBy(*KEY).orderBy(*order))).filter(F.col("pick") <= F.col("_n")).drop("_n")


# Fixed values of the study plan.
REVIEW_TITLE = "Ôn tập tổng hợp trước kỳ thi"
STUDY_PREFIX = "Học: "


def study_plan(plans: DataFrame, units: DataFrame) -> DataFrame:
    """Study tasks of each plan from the units of its owner and subject.

    The unit length is constant within a plan, so the day of unit ``r`` is a division, not a loop.
    Plans without units or with the exam before the start give no tasks.
    """
    p = plans.filter("exam_date >= start_date").select("plan_id", "user_id", "subject_id", "start_date", "exam_date", "daily_minutes")
    u = units.withColumnRenamed("owner_id", "user_id")
    by_subject = p.filter("subject_id is not null").join(u, ["user_id", "subject_id"])
    whole = p.filter("subject_id is null").drop("subject_id").join(u, "user_id")
    mine = by_subject.unionByName(whole.select(by_subject.columns))
    order = [F.col("created_on"), F.col("document_id"), F.coalesce("section_order", F.lit(0)), F.coalesce("section_id", F.lit(0))]
    r = numbered(mine, ["plan_id"], [F.col("created_on"), F.col("document_id")], order, "_r").withColumn("_r", F.col("_r") - 1)
    half = F.floor(F.col("daily_minutes") / 2)
    unit = F.greatest(F.lit(15), F.least(F.lit(45), F.when(half == 0, F.lit(30)).otherwise(half))).cast("int")
    days = F.datediff("exam_date", "start_date") + 1
    study_days = F.when(days > 2, days - 1).otherwise(days)
    r = r.withColumns({"_unit": unit, "_last": (study_days - 1).cast("long")}).withColumn(
        "_per_day", F.floor(F.col("daily_minutes") / F.col("_unit")))
    fits = F.col("_per_day") >= 1
    day = F.least(F.col("_last"), F.when(fits, F.floor(F.col("_r") / F.greatest(F.lit(1), F.col("_per_day"))))
                  .otherwise(F.col("_r") + 1)).cast("int")
    r = r.withColumn("_day", day)
    first_on_day = F.when(fits, F.col("_day") * F.col("_per_day")).otherwise(F.greatest(F.lit(0), F.col("_day") - 1))
    study = r.select("plan_id", "document_id", "section_id", F.date_add("start_date", F.col("_day")).alias("task_date"),
                     F.lit("STUDY").alias("task_type"), F.concat(F.lit(STUDY_PREFIX), "label").alias("title"),
                     F.col("_unit").alias("estimated_minutes"), (F.col("_r") - first_on_day).cast("long").alias("sort_order"))
    review = (p.join(r.select("plan_id").distinct(), "plan_id", "left_semi").filter("exam_date > start_date")
              .select("plan_id", F.lit(None).cast("long").alias("document_id"), F.lit(None).cast("long").alias("section_id"),
                      F.col("exam_date").alias("task_date"), F.lit("REVIEW").alias("task_type"),
                      F.lit(REVIEW_TITLE).alias("title"), F.col("daily_minutes").alias("estimated_minutes"),
                      F.lit(0).cast("long").alias("sort_order")))
    return study.unionByName(review)


def active_chunks(chunks: DataFrame, newest: Column | str = "created_at") -> DataFrame:
    """Chunks with ``is_active`` set for the newest chunk set of each document only."""
    newest = F.col(newest) if isinstance(newest, str) else newest
    latest = chunks.groupBy("document_id").agg(F.max_by("chunk_set_id", F.struct(newest, F.col("chunk_set_id"))).alias("_set"))
    return (chunks.join(latest, "document_id")
            .withColumn("is_active", F.col("chunk_set_id") == F.col("_set")).drop("_set"))


# Fixed values of quiz source selection.
LONG_CHUNK, SHORT_CHUNK = 500, 200
TOC_MARKERS = ("MỤC LỤC", "TABLE OF CONTENTS")
CHAPTER_WORD = "CHƯƠNG"


def is_toc(content: Column) -> Column:
    """A table of contents by its marker and at least three chapter words in the first 700 characters."""
    head = F.substring(F.upper(strip(F.coalesce(content, F.lit("")))), 1, 700)
    marked = F.lit(False)
    for m in TOC_MARKERS:
        marked = marked | F.contains(head, F.lit(m))
    return marked & (F.regexp_count(head, F.lit(CHAPTER_WORD)) >= 3)


def order_by_section_rank(chunks: DataFrame, ranks: DataFrame | None = None, chunks_read: int | None = None) -> DataFrame:
    """The chunks of a request numbered by section rank, document and index (``idx`` from 0).

    All chunks are read, or the first ``chunks_read`` by document and index (120 for one interactive request).
    Requests of any size are ranked document by document.
    """
    order = [F.asc("document_id"), F.asc("chunk_index")]
    head = chunks if chunks_read is None else top_per_key(chunks, ["request_id"], order, chunks_read, "_read").drop("_read")
    bucket = [F.col("document_id")]
    if ranks is not None:
        head = head.join(ranks.select("request_id", "section_id", F.col("rank").alias("_rank")), ["request_id", "section_id"], "left")
        head = head.withColumn("_rank", F.coalesce("_rank", F.lit(999999)))
        order, bucket = [F.asc("_rank"), *order], [F.col("_rank"), *bucket]
    return numbered(head, ["request_id"], bucket, order, "idx").withColumn("idx", F.col("idx") - 1).drop("_rank")


def source_tier(content: Column) -> Column:
    """W9 for one text: 1 for a long chunk that is no table of contents, 2 for one of 200 characters, else 3."""
    size = F.length(strip(F.coalesce(content, F.lit(""))))
    return F.when((size >= LONG_CHUNK) & ~is_toc(content), 1).when(size >= SHORT_CHUNK, 2).otherwise(3)


def candidate_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks of a request's best tier that has any, and better ones.

    Chunks come with their text, or with ``_tier`` in its place where only ranks are wanted.
    """
    marked = chunks if "_tier" in chunks.columns else chunks.withColumn("_tier", source_tier(F.col("content")))
    best = marked.groupBy("request_id").agg(F.min("_tier").alias("_best"))
    return marked.join(best, "request_id").filter(F.col("_tier") <= F.col("_best")).drop("_tier", "_best")


def spread_sample(candidates: DataFrame, requests: DataFrame, max_sources: int | None = None) -> DataFrame:
    """Evenly spaced source chunks per request (``pick`` from 0), ties rounded half to even.

    ``candidates`` come with their ``idx``; ``requests``: request_id, question_count.  There is a source for every
    question as far as candidates go, or at most ``max_sources`` (6 for one interactive request).  Steps are at
    least one, so no two picks coincide.
    """
    pos = numbered(candidates, ["request_id"], [F.floor(F.col("idx") / 4096)], [F.asc("idx")], "_pos").withColumn("_pos", F.col("_pos") - 1)
    n = pos.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    k = F.greatest(F.lit(1), F.least(F.col("_n"), F.col("question_count"), F.lit(max_sources).cast("long"))).cast("int")
    picks = (n.join(requests.select("request_id", "question_count"), "request_id").withColumn("_k", k)
             .withColumn("pick", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
             .withColumn("_pos", F.when(F.col("_k") <= 1, F.lit(0)).otherwise(
                 F.rint(F.col("pick") * (F.col("_n") - 1) / (F.col("_k") - 1))).cast("int"))
             .select("request_id", "question_count", "_pos", "pick", F.col("_k").alias("source_count")))
    return pos.join(picks, ["request_id", "_pos"]).drop("_pos")


def allocate(sources: DataFrame) -> DataFrame:
    """One row per question slot; the first ``q mod k`` sources get one question more."""
    q, k = F.col("question_count"), F.col("source_count")
    base = F.floor(q / k)
    extra = q % k
    count = base + F.when(F.col("pick") < extra, 1).otherwise(0)
    first = F.col("pick") * base + F.least(F.col("pick"), extra)
    return (sources.withColumns({"questions": count.cast("int"), "_first": first.cast("long")}).filter("questions > 0")
            .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("questions") - 1)))
            .withColumn("slot", (F.col("_first") + F.col("turn")).cast("long")).drop("_first"))


def assign_contexts(slots: DataFrame, contexts: DataFrame) -> DataFrame:
    """The i-th slot of a chunk in a request takes context ``i mod m`` of the chunk.

    ``slots``: request_id, slot, chunk_id, turn; ``contexts``: chunk_id, rank (from 1), text, ...
    """
    size = contexts.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_m"))
    return (slots.join(size, "chunk_id").withColumn("rank", (F.col("turn") % F.col("_m") + 1).cast("int"))
            .join(contexts, ["chunk_id", "rank"]).drop("_m"))


def preselect_answers(slots: DataFrame, candidates: DataFrame, best: int | None = None) -> DataFrame:
    """One answer per slot; slots of the same source rotate over its candidates, best first, or the ``best`` first.

    ``slots``: request_id, slot, source_ref; ``candidates``: source_ref, answer_id, score, ... and ``usable``.
    """
    order = [F.desc("score"), F.asc("answer_id")]
    usable = candidates.filter("usable")
    kept = (usable.withColumn("_rank", F.row_number().over(W.partitionBy("source_ref").orderBy(*order))) if best is None
            else top_per_key(usable, ["source_ref"], order, best, "_rank"))
    size = kept.groupBy("source_ref").agg(F.count(F.lit(1)).alias("_m"))
    use = F.row_number().over(W.partitionBy("request_id", "source_ref").orderBy("slot")) - 1
    return (slots.withColumn("_use", use).join(size, "source_ref")
            .withColumn("_rank", (F.col("_use") % F.col("_m") + 1).cast("int"))
            .join(kept, ["source_ref", "_rank"]).drop("_use", "_m", "_rank"))


def dedupe_questions(questions: DataFrame, used: DataFrame | None = None, scope: str = "quiz_id") -> DataFrame:
    """First question per normalized text and scope, not among ``used`` (scope, question_text).

    The first row is found by an aggregate, which is combined before the shuffle.
    """
    norm = norm_compare(F.col("question_text"))
    rest = [c for c in questions.columns if c != scope]
    first = (questions.withColumn("_norm", norm).groupBy(scope, "_norm")
             .agg(F.min_by(F.struct(*rest), F.col("question_order")).alias("_row")))
    if used is not None:
        first = first.join(used.select(scope, norm.alias("_norm")), [scope, "_norm"], "left_anti")
    return first.select(scope, "_row.*")


def recent_xp(transactions: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` XP transactions per user."""
    return top_per_key(transactions, ["user_id"], [F.desc("at"), F.desc("source_id"), F.desc("source_type")], n, "pos")
