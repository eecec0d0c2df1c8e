"""Joins over answers, attempts, topics and cards (J), and the aggregates on them (A)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from studyloom.functions.mastery import level, mastery_class
from studyloom.operators.numbering import fold_segments, full_segments, packed_map, segment_starts, segments, started, top_per_key
from studyloom.session import cut


def topic_performance(answers, attempts, questions, chunks, docs, sections) -> DataFrame:
    """J1 + A1: answered, correct, wrong and accuracy per user, subject, document and section.

    Answers are counted per (user, chunk) before the text-side tables are joined, so that the later
    joins move grouped rows only.
    """
    a = answers.select("attempt_id", "question_id", "is_correct")
    s = attempts.filter(F.col("status") == "SUBMITTED").select(F.col("id").alias("attempt_id"), "user_id")
    q = (questions.filter(F.col("source_chunk_id").isNotNull())
         .select(F.col("id").alias("question_id"), F.col("source_chunk_id").alias("chunk_id")))
    per_chunk = (a.join(s, "attempt_id").join(q, "question_id").groupBy("user_id", "chunk_id")
                 .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("c"),
                      F.count_if(~F.col("is_correct")).alias("w")))
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "section_id")
    d = docs.select(F.col("id").alias("document_id"), "subject_id")
    t = sections.select(F.col("id").alias("section_id"), F.col("title").alias("section_title"))
    joined = per_chunk.join(c, "chunk_id").join(d, "document_id").join(t, "section_id", "left")
    n, ok = F.sum("n"), F.sum("c")
    return joined.groupBy("user_id", "subject_id", "document_id", "section_id", "section_title").agg(
        n.alias("answered_count"), ok.alias("correct_count"), F.sum("w").alias("wrong_count"),
        F.round(F.lit(100).cast("decimal(5,1)") * ok.cast("decimal(18,0)") / F.nullif(n, F.lit(0)).cast("decimal(18,0)"), 2)
        .alias("accuracy_percent"))


def topic_mastery_list(sections, docs, mastery, scope) -> DataFrame:
    """Every section of the scope's READY documents with its mastery, zeros if never practised."""
    ready = docs.filter("status = 'READY' and subject_id is not null").select(
        F.col("id").alias("document_id"), "subject_id")
    units = sections.select(F.col("id").alias("section_id"), "document_id", "title", "section_order")
    listed = scope.select("user_id", "subject_id").join(ready.join(units, "document_id"), "subject_id")
    m = mastery.select("user_id", "subject_id", "section_id", "attempts", "correct_answers", "wrong_answers",
                       F.col("mastery_score").cast("double").alias("mastery_score"), "last_practiced_at")
    out = listed.join(m, ["user_id", "subject_id", "section_id"], "left").select(
        "user_id", "subject_id", "section_id", "title", "section_order",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("attempts", "correct_answers", "wrong_answers")],
        F.coalesce("mastery_score", F.lit(0.0)).alias("mastery_score"), "last_practiced_at")
    return out.withColumn("status", mastery_class(F.col("attempts"), F.col("mastery_score")))


def attempt_summary(attempts, quizzes) -> DataFrame:
    """Attempts with the title of their quiz."""
    q = quizzes.select(F.col("id").alias("quiz_id"), F.col("title").alias("quiz_title"))
    return attempts.withColumnRenamed("id", "attempt_id").join(q, "quiz_id")


def due_cards_view(progress, cards, as_of: Column) -> DataFrame:
    """Reviewed cards whose next review is not later than ``as_of``."""
    c = cards.select(F.col("id").alias("flashcard_id"), "deck_id", "front_text", "back_text")
    return progress.filter(F.col("next_review_at") <= as_of).join(c, "flashcard_id")


def due_queue(decks, cards, progress, as_of: Column, k: int = 50) -> DataFrame:
    """First ``k`` due cards of each deck owner; cards never reviewed come first."""
    owned = decks.select(F.col("id").alias("deck_id"), F.col("owner_id").alias("user_id")).join(
        cards.select(F.col("id").alias("flashcard_id"), "deck_id", "front_text"), "deck_id")
    p = progress.select("user_id", "flashcard_id", "next_review_at")
    due = owned.join(p, ["user_id", "flashcard_id"], "left").filter(
        F.col("next_review_at").isNull() | (F.col("next_review_at") <= as_of))
    return top_per_key(due, ["user_id"], [F.asc_nulls_first("next_review_at"), F.asc("flashcard_id")], k, "queue_pos")


def accessible_subjects(subjects, members) -> DataFrame:
    """(user_id, subject) pairs by ownership or membership; a pair counts once."""
    own = subjects.select(F.col("owner_id").alias("user_id"), F.col("id").alias("subject_id"))
    shared = members.select("user_id", "subject_id").join(subjects.select(F.col("id").alias("subject_id")),
                                                         "subject_id", "left_semi")
    return own.unionByName(shared).distinct()


def accessible_subject_rows(subjects, members) -> DataFrame:
    """J7, the other number: rows of the outer join to members, as (user_id, rows)."""
    m = members.select("subject_id", F.col("user_id").alias("member_id"))
    joined = (subjects.select(F.col("id").alias("subject_id"), "owner_id").join(m, "subject_id", "left")
              .withColumn("user_id", F.explode(F.array_distinct(F.array_compact(F.array("owner_id", "member_id"))))))
    return joined.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))


def missing_embeddings(chunks, embeddings, force: bool = False) -> DataFrame:
    """Active chunks to embed; all of them when forced."""
    active = chunks.filter("is_active")
    return active if force else active.join(embeddings.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def bad_selections(answers, options) -> DataFrame:
    """Selected options that are not options of the answered question."""
    keys = options.select(F.col("id").alias("selected_option_id"), "question_id")
    return answers.filter(F.col("selected_option_id").isNotNull()).join(
        keys, ["selected_option_id", "question_id"], "left_anti")


def foreign_answers(answers, attempts, quiz_questions) -> DataFrame:
    """Answers to questions that are not in the attempt's quiz."""
    a = answers.join(attempts.select(F.col("id").alias("attempt_id"), "quiz_id"), "attempt_id")
    return a.join(quiz_questions.select("quiz_id", "question_id"), ["quiz_id", "question_id"], "left_anti")


def earned_badges(user_badges, badges) -> DataFrame:
    """Badges of each user with their definition."""
    return user_badges.join(badges.select(F.col("code").alias("badge_code"), "xp_reward"), "badge_code")


def study_units(docs, sections) -> DataFrame:
    """Sections of READY documents; a document without sections is one unit."""
    d = docs.filter("status = 'READY'").select(
        F.col("id").alias("document_id"), "owner_id", "subject_id", "original_name", "created_on")
    s = sections.select(F.col("id").alias("section_id"), "document_id", "title", "section_order")
    label = (F.when(F.col("section_id").isNull(), F.col("original_name"))
             .when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title"))
             .otherwise(F.concat(F.lit("Section "), (F.col("section_order") + 1).cast("string"))))
    return d.join(s, "document_id", "left").withColumn("label", label).drop("title")


def plan_tasks(plans, tasks) -> DataFrame:
    """Tasks with the user of their plan."""
    return tasks.join(plans.select("plan_id", "user_id"), "plan_id")


def score_attempts(attempts, quiz_questions, answers, options) -> DataFrame:
    """A2: score submitted attempts; attempts with a bad selection or a foreign answer are rejected whole.

    ``quiz_questions``: quiz_id, question_id, points.  A question without an answer row is unanswered.
    """
    chosen = answers.select("attempt_id", "question_id", "selected_option_id", F.lit(True).alias("_given")).join(
        options.select(F.col("id").alias("selected_option_id"), "question_id", F.col("is_correct").alias("right")),
        ["selected_option_id", "question_id"], "left")
    open_attempts = attempts.withColumnRenamed("id", "attempt_id")
    asked = open_attempts.select("attempt_id", "quiz_id").join(
        quiz_questions.select("quiz_id", "question_id", "points"), "quiz_id").drop("quiz_id").withColumn("_asked", F.lit(True))
    # One outer join shows unanswered questions, foreign answers and bad selections alike.
    sheet = asked.join(chosen, ["attempt_id", "question_id"], "full")
    known, right = F.coalesce("_asked", F.lit(False)), F.coalesce("right", F.lit(False))
    picked = F.col("selected_option_id").isNotNull()
    zero = F.lit(0).cast("decimal(8,2)")
    totals = sheet.groupBy("attempt_id").agg(
        F.sum("points").alias("max_score"), F.sum(F.when(right, F.col("points")).otherwise(zero)).alias("score"),
        F.count_if(right).alias("correct_count"), F.count_if(picked & ~right).alias("wrong_count"),
        F.count_if(known & ~picked).alias("unanswered_count"),
        F.max(~known | (picked & F.col("right").isNull())).alias("_rejected"))
    none = F.coalesce("max_score", F.lit(0)) == 0
    pct = F.when(none, F.lit(0).cast("decimal(6,2)")).otherwise(
        F.bround(F.col("score") * 100 / F.col("max_score"), 2).cast("decimal(6,2)"))
    spent = F.greatest(F.lit(0), F.floor((F.unix_micros(F.col("submitted_at").cast("timestamp"))
                                         - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000000))
    return (open_attempts.join(totals, "attempt_id", "left").filter(~F.coalesce("_rejected", F.lit(False))).drop("_rejected")
            .withColumns({"percentage": pct, "time_spent_seconds": spent.cast("long")})
            .fillna(0, ["max_score", "score", "correct_count", "wrong_count", "unanswered_count"]))


def topic_mastery(scored) -> DataFrame:
    """A3: fold answers per (user, section).

    ``scored``: user_id, subject_id (of the quiz), section_id, is_correct, practiced_at, tie.
    Unanswered rows count as attempts but not as wrong answers.
    """
    rows = scored.filter(F.col("subject_id").isNotNull() & F.col("section_id").isNotNull() & (F.col("section_id") != 0))
    out = rows.groupBy("user_id", "section_id").agg(
        F.min_by("subject_id", F.struct("practiced_at", "tie")).alias("subject_id"),
        F.count(F.lit(1)).alias("attempts"), F.count_if("is_correct").alias("correct_answers"),
        F.count_if(~F.col("is_correct")).alias("wrong_answers"), F.max("practiced_at").alias("last_practiced_at"))
    share = F.col("correct_answers").cast("decimal(18,0)") * 100 / F.greatest(F.lit(1), F.col("attempts")).cast("decimal(18,0)")
    return out.withColumn("mastery_score", F.bround(share, 2).cast("decimal(6,2)"))


def daily_stats(attempts, reviews, xp) -> DataFrame:
    """A4: one row per (user, day).  Each source is summed before the union, then the sums are merged.

    ``attempts``: user_id, activity_date, questions, correct; ``reviews``: user_id, activity_date;
    ``xp``: user_id, activity_date, amount.
    """
    key = ["user_id", "activity_date"]
    zero = F.lit(0).cast("long")
    a = attempts.groupBy(*key).agg(F.count(F.lit(1)).alias("quiz_attempts"), F.sum("questions").alias("questions_answered"),
                                   F.sum("correct").alias("correct_answers"), zero.alias("flashcards_reviewed"),
                                   zero.alias("xp_earned"))
    r = reviews.groupBy(*key).agg(zero.alias("quiz_attempts"), zero.alias("questions_answered"),
                                  zero.alias("correct_answers"), F.count(F.lit(1)).alias("flashcards_reviewed"),
                                  zero.alias("xp_earned"))
    x = xp.groupBy(*key).agg(zero.alias("quiz_attempts"), zero.alias("questions_answered"), zero.alias("correct_answers"),
                             zero.alias("flashcards_reviewed"), F.sum("amount").alias("xp_earned"))
    return merge_aggregate(a.unionByName(r), x, key, sums=["quiz_attempts", "questions_answered", "correct_answers",
                                                           "flashcards_reviewed", "xp_earned"])


def merge_aggregate(target: DataFrame, delta: DataFrame, keys: Sequence[str], sums: Sequence[str] = (),
                    maxes: Sequence[str] = ()) -> DataFrame:
    """Add ``delta`` to ``target`` per key; missing rows are created."""
    cols = [*keys, *sums, *maxes]
    return (target.select(*cols).unionByName(delta.select(*cols)).groupBy(*keys)
            .agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes]))


# Means are hundredths of a percentage.
MEANS = 100 * 100 + 1


def _next_mean(mean, n, percentage):
    """Half away from zero on whole hundredths: what storing the quotient in numeric(6,2) does."""
    return (2 * (mean * (n - 1) + percentage) + n) // (2 * n)


def _mean_map(keys: Sequence[str]):
    """What a segment makes of every mean before it: its numbers are fixed, so each step is a map of the 10,001 hundredths."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        mean = np.arange(MEANS, dtype=np.int64)
        for n, percentage in zip(table["_n"].to_pylist(), table["pct"].to_pylist()):
            mean = _next_mean(mean, n, percentage)
        return pa.table({**{k: table[k].slice(0, 1) for k in (*keys, "_segment")}, "_map": pa.array([packed_map(mean)], pa.binary())})

    return run


def subject_progress_history(attempts) -> DataFrame:
    """A5 before taking the last row: running count and twice-rounded running mean after each attempt, of percentages from 0 to 100.

    The attempts of one user and subject are any number of segments, each a task's work of its own.
    """
    keys = ["user_id", "subject_id"]
    rows = attempts.filter(F.col("subject_id").isNotNull() & F.col("percentage").isNotNull()).select(
        *keys, "submitted_at", "attempt_id", F.round(F.col("percentage") * 100).cast("long").alias("pct"))
    rows = cut(segments(rows, keys, [F.coalesce(F.to_date("submitted_at"), F.lit("0001-01-01").cast("date"))], [F.asc("submitted_at"), F.asc("attempt_id")]))
    full = full_segments(rows, keys)
    if full.limit(1).count():
        maps = full.groupBy(*keys, "_segment").applyInArrow(_mean_map(keys), T.StructType([*[rows.schema[k] for k in (*keys, "_segment")], T.StructField("_map", T.BinaryType())]))
        rows = started(rows, segment_starts(maps, keys, lambda state: state, 0), keys, _start=0)
    else:
        rows = rows.withColumn("_start", F.lit(0).cast("long"))

    def begin(batch: pa.RecordBatch, first: np.ndarray) -> list[np.ndarray]:
        return [batch.column("_start").to_numpy()[first].copy()]

    def step(state: list[np.ndarray], batch: pa.RecordBatch, at: np.ndarray) -> list[np.ndarray]:
        return [_next_mean(state[0], batch.column("_n").to_numpy()[at], batch.column("pct").to_numpy()[at])]

    def emit(batch: pa.RecordBatch, before: list[np.ndarray], after: list[np.ndarray]) -> pa.RecordBatch:
        columns = [batch.column("user_id"), batch.column("subject_id"), batch.column("_n"), pa.array(after[0] / 100.0), batch.column("submitted_at")]
        return pa.RecordBatch.from_arrays(columns, ["user_id", "subject_id", "quizzes_completed", "average_score", "last_activity_at"])

    fields = [rows.schema[k] for k in keys] + [T.StructField("quizzes_completed", T.LongType()), T.StructField("average_score", T.DoubleType()),
                                               T.StructField("last_activity_at", rows.schema["submitted_at"].dataType)]
    return fold_segments(rows, keys, begin, step, emit, T.StructType(fields))


def subject_progress(attempts) -> DataFrame:
    """A5: quizzes completed, running mean with two decimals kept at each step, last activity."""
    return subject_progress_history(attempts).groupBy("user_id", "subject_id").agg(
        F.max("quizzes_completed").alias("quizzes_completed"),
        F.max_by("average_score", "quizzes_completed").alias("average_score"),
        F.max_by("last_activity_at", "quizzes_completed").alias("last_activity_at"))


def xp_state(events) -> DataFrame:
    """XP total and level per user for events (user_id, amount, at, id).

    The running rule ``max(0, total + amount)`` equals the plain sum minus the lowest prefix sum if
    that is negative.  Prefix sums are formed per user and day, then over the days, so a user with very
    many events is not handled by one task.
    """
    day = events.withColumn("_day", F.to_date("at"))
    w = W.partitionBy("user_id", "_day").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)
    per_day = (day.withColumn("_run", F.sum("amount").over(w)).groupBy("user_id", "_day")
               .agg(F.sum("amount").alias("s"), F.min("_run").alias("low")))
    before = W.partitionBy("user_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    total = (per_day.withColumn("_low", F.coalesce(F.sum("s").over(before), F.lit(0)) + F.col("low"))
             .groupBy("user_id").agg((F.sum("s") - F.least(F.lit(0), F.min("_low"))).alias("xp_total")))
    return total.withColumn("level_no", level(F.col("xp_total")))


# Badge codes, their reward and threshold.
BADGES = (("FIRST_QUIZ", 50), ("PERFECT_SCORE", 100), ("STREAK_7", 150), ("FLASHCARD_100", 100))
STREAK_DAYS, REVIEW_COUNT = 7, 100

# Amounts added per event.
XP_QUIZ_BASE, XP_PER_CORRECT, XP_REVIEW = 10, 2, 2


def xp_events(scored, reviews, badges=None) -> DataFrame:
    """XP ledger rows of submitted attempts, card reviews and earned badges (user_id, badge_code, earned_on).

    A badge adds its reward on the day it was earned; its place in ``BADGES`` (from 1) is its source.
    """
    q = scored.select("user_id", (F.lit(XP_QUIZ_BASE) + F.col("correct_count") * XP_PER_CORRECT).cast("long").alias("amount"),
                      F.lit("QUIZ_ATTEMPT").alias("source_type"), F.col("attempt_id").alias("source_id"),
                      F.col("submitted_at").alias("at"))
    r = reviews.select("user_id", F.lit(XP_REVIEW).cast("long").alias("amount"),
                       F.lit("FLASHCARD_REVIEW").alias("source_type"), F.col("id").alias("source_id"),
                       F.col("reviewed_at").alias("at"))
    if badges is None:
        return q.unionByName(r)
    rewards = F.create_map(*[F.lit(x) for code, reward in BADGES for x in (code, reward)])
    numbers = F.create_map(*[F.lit(x) for n, (code, _) in enumerate(BADGES, 1) for x in (code, n)])
    b = badges.select("user_id", rewards[F.col("badge_code")].cast("long").alias("amount"), F.lit("BADGE").alias("source_type"),
                      numbers[F.col("badge_code")].cast("long").alias("source_id"), F.col("earned_on").cast("timestamp").alias("at"))
    return q.unionByName(r).unionByName(b.select(q.columns))


def streaks(activity) -> DataFrame:
    """Current and longest run of consecutive active days.  Rows per user are its distinct days."""
    islands = _islands(activity)
    runs = islands.groupBy("user_id", "_island").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last"))
    return runs.groupBy("user_id").agg(F.max_by("n", "last").alias("current_streak"), F.max("n").alias("longest_streak"),
                                       F.max("last").alias("last_study_date"))


def _islands(activity) -> DataFrame:
    days = activity.select("user_id", "day").distinct()
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("day"))
    return days.withColumn("_rn", rn).withColumn("_island", F.date_sub("day", F.col("_rn")))


def earn_badges(scored, reviews, activity, owned=None, active: Sequence[str] = tuple(b for b, _ in BADGES)) -> DataFrame:
    """Badges each user earns, with the day of the deciding event; owned badges are not granted again.

    ``scored``: user_id, percentage, day (submitted attempts); ``reviews``: user_id, day, id;
    ``activity``: user_id, day.
    """
    first = scored.groupBy("user_id").agg(F.min("day").alias("earned_on")).withColumn("badge_code", F.lit("FIRST_QUIZ"))
    perfect = (scored.filter("percentage >= 100").groupBy("user_id").agg(F.min("day").alias("earned_on"))
               .withColumn("badge_code", F.lit("PERFECT_SCORE")))
    island = W.partitionBy("user_id", "_island").orderBy("day")
    streak = (_islands(activity).withColumn("_n", F.row_number().over(island)).filter(F.col("_n") == STREAK_DAYS)
              .groupBy("user_id").agg(F.min("day").alias("earned_on")).withColumn("badge_code", F.lit("STREAK_7")))
    hundredth = (top_per_key(reviews, ["user_id"], [F.asc("day"), F.asc("id")], REVIEW_COUNT)
                 .filter(F.col("rn") == REVIEW_COUNT)
                 .select("user_id", F.col("day").alias("earned_on"), F.lit("FLASHCARD_100").alias("badge_code")))
    out = first.unionByName(perfect).unionByName(streak).unionByName(hundredth).filter(F.col("badge_code").isin(*active))
    return out if owned is None else out.join(owned.select("user_id", "badge_code"), ["user_id", "badge_code"], "left_anti")


def mastery_summary(topics) -> DataFrame:
    """Topics per status."""
    return topics.groupBy("user_id", "subject_id").agg(
        F.count(F.lit(1)).alias("total_topics"),
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_topics")
          for s in ("WEAK", "DEVELOPING", "STRONG", "NOT_ENOUGH_DATA")])


def chunk_set_audit(chunks) -> DataFrame:
    """Chunks per set, algorithm and active flag."""
    return chunks.groupBy("chunk_set_id", "chunking_algorithm", "is_active").agg(F.count(F.lit(1)).alias("chunk_count"))


def toggle_state(events) -> DataFrame:
    """A10: (post, user, kind) pairs that are on, i.e. toggled an odd number of times."""
    return (events.groupBy("post_id", "user_id", "kind").agg((F.count(F.lit(1)) % 2).alias("_odd"))
            .filter("_odd = 1").drop("_odd"))


def public_resources(posts, users, likes, saves) -> DataFrame:
    """Published posts with owner name and counts; likes and saves are counted before the joins."""
    l = likes.groupBy("post_id").agg(F.count(F.lit(1)).alias("like_count"))
    s = saves.groupBy("post_id").agg(F.count(F.lit(1)).alias("save_count"))
    u = users.select(F.col("id").alias("owner_id"), F.col("full_name").alias("owner_name"))
    return (posts.filter("status = 'PUBLISHED'").withColumnRenamed("id", "post_id").join(u, "owner_id")
            .join(l, "post_id", "left").join(s, "post_id", "left")
            .fillna(0, ["like_count", "save_count"])
            .select("post_id", "owner_id", "owner_name", "quiz_id", "flashcard_deck_id", "title", "published_at",
                    "like_count", "save_count"))


def _copied(df: DataFrame, own: Sequence[str]) -> list[str]:
    """Columns a fork takes over as they are: all but the keys and those it sets itself."""
    return [c for c in df.columns if c not in own]


def fork_quizzes(forks, posts, quizzes, questions, options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U-5 for quizzes: ``forks`` (post_id, user_id) of published posts -> new quizzes, questions, options.

    A fork is a private draft without subject; its questions lose their source chunk.  Every other column of the quiz,
    its questions and options is copied: description, difficulty, duration, mode, explanations and whatever else the
    tables hold.  New keys are made of the post, the user and the copied row's id, so no global numbering is needed.
    """
    p = posts.filter("status = 'PUBLISHED' and quiz_id is not null").select(F.col("id").alias("post_id"), "quiz_id")
    key = F.concat_ws(":", "post_id", "user_id")
    asked = forks.select("post_id", "user_id").distinct().join(p, "post_id").withColumn("fork_key", key).drop("post_id")
    rest = _copied(quizzes, ("id", "owner_id", "source_quiz_id", "subject_id", "title", "status", "visibility", "created_at", "published_at"))
    src = quizzes.select(F.col("id").alias("quiz_id"), "title", *rest)
    new_quizzes = asked.join(src, "quiz_id").select(
        "fork_key", F.col("user_id").alias("owner_id"), F.col("quiz_id").alias("source_quiz_id"),
        F.lit(None).cast("long").alias("subject_id"), F.concat("title", F.lit(" (fork)")).alias("title"),
        F.lit("DRAFT").alias("status"), F.lit("PRIVATE").alias("visibility"), *rest)
    rest = _copied(questions, ("id", "quiz_id", "source_chunk_id"))
    q = asked.select("fork_key", "quiz_id").join(questions, "quiz_id")
    new_questions = q.select("fork_key", F.concat_ws(":", "fork_key", "id").alias("question_key"),
                             F.lit(None).cast("long").alias("source_chunk_id"), *rest)
    new_options = q.select(F.concat_ws(":", "fork_key", "id").alias("question_key"), F.col("id").alias("question_id")).join(
        options, "question_id").select("question_key", *_copied(options, ("id", "question_id")))
    return new_quizzes, new_questions, new_options


def fork_decks(forks, posts, decks, cards) -> tuple[DataFrame, DataFrame]:
    """U-5 for decks: private draft copies with all other columns of the deck and its cards (description, mode, hints)."""
    p = posts.filter("status = 'PUBLISHED' and quiz_id is null").select(
        F.col("id").alias("post_id"), F.col("flashcard_deck_id").alias("deck_id"))
    asked = (forks.select("post_id", "user_id").distinct().join(p, "post_id")
             .withColumn("fork_key", F.concat_ws(":", "post_id", "user_id")).drop("post_id"))
    rest = _copied(decks, ("id", "owner_id", "source_deck_id", "subject_id", "title", "status", "visibility", "created_at"))
    new_decks = asked.join(decks.select(F.col("id").alias("deck_id"), "title", *rest), "deck_id").select(
        "fork_key", F.col("user_id").alias("owner_id"), F.col("deck_id").alias("source_deck_id"),
        F.concat("title", F.lit(" (fork)")).alias("title"), F.lit("DRAFT").alias("status"), F.lit("PRIVATE").alias("visibility"), *rest)
    new_cards = asked.select("fork_key", "deck_id").join(cards, "deck_id").select(
        "fork_key", F.lit(None).cast("long").alias("source_chunk_id"), *_copied(cards, ("id", "deck_id", "source_chunk_id")))
    return new_decks, new_cards
