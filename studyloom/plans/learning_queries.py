"""Queries over answers, attempts, topics, cards and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import access, learning, lists, planning, reviews as rv
from studyloom.plans.registry import query
from studyloom.plans.views import oracle

AS_OF = "2002-01-01 12:00:00"
AS_OF_CARDS = "2024-02-05 00:00:00"


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def double(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# ------------------------------------------------------------------------------------ J1, A1
@query("topic_performance", oracle("answers attempts questions chunks ldocs sections", """
select a.user_id, d.subject_id, c.document_id, c.section_id, s.title as section_title, count(*) as answered_count,
  count(*) filter (where x.is_correct) as correct_count, count(*) filter (where not x.is_correct) as wrong_count,
  cast(round(cast(100.0 * count(*) filter (where x.is_correct) as decimal(18,6)) / count(*), 2) as double) as accuracy_percent
from answers x join attempts a on a.id = x.attempt_id join questions q on q.id = x.question_id
join chunks c on c.id = q.source_chunk_id join ldocs d on d.id = c.document_id left join sections s on s.id = c.section_id
where a.status = 'SUBMITTED' group by all"""))
def topic_performance(t):
    return double(learning.topic_performance(t.answers, t.attempts, t.questions, t.chunks, t.documents, t.sections),
                  "accuracy_percent")


# ------------------------------------------------------------------------------------ A2
def quiz_of_attempt(t):
    """Each order is one quiz: its questions are the order's parts."""
    attempts = t.attempts.filter("status = 'SUBMITTED'").withColumn("quiz_id", F.col("id"))
    qq = t.answers.select(F.col("attempt_id").alias("quiz_id"), "question_id").join(
        t.questions.select(F.col("id").alias("question_id"), "points"), "question_id")
    given = t.answers.filter("selected_option_id is not null or question_id % 2 = 0")
    bad = given.withColumn("selected_option_id", F.when(F.expr("attempt_id % 101 = 7"), F.col("selected_option_id") + 4)
                           .otherwise(F.col("selected_option_id")))
    return attempts, qq, bad


def scored(t):
    attempts, qq, given = quiz_of_attempt(t)
    return learning.score_attempts(attempts, qq, given, t.options)


SCORED = {"sheet": (("answers", "questions", "attempts", "options"), """
    select a.id as attempt_id, a.user_id, a.submitted_at, a.started_at, q.points, x.question_id,
      case when a.id % 101 = 7 then x.selected_option_id + 4 else x.selected_option_id end as chosen, x.selected_option_id
    from attempts a left join answers x on x.attempt_id = a.id left join questions q on q.id = x.question_id where a.status = 'SUBMITTED'"""),
    "scored": (("sheet",), """select s.attempt_id, s.user_id, s.submitted_at, s.started_at, coalesce(sum(points), 0) as max_score,
      sum(case when coalesce(o.is_correct, false) then points else 0 end) as score,
      count(*) filter (where coalesce(o.is_correct, false)) as correct_count,
      count(*) filter (where chosen is not null and not coalesce(o.is_correct, false)) as wrong_count,
      count(*) filter (where s.question_id is not null and chosen is null) as unanswered_count,
      greatest(0, cast(epoch(submitted_at) - epoch(started_at) as bigint)) as time_spent_seconds,
      coalesce(cast(round_even(cast(sum(case when coalesce(o.is_correct, false) then points else 0 end) as double) * 100 / cast(sum(points) as double), 2) as double), 0) as percentage
    from sheet s left join options o on o.id = s.chosen and o.question_id = s.question_id
    where s.attempt_id not in (select s2.attempt_id from sheet s2 left join options o2 on o2.id = s2.chosen
      and o2.question_id = s2.question_id where s2.chosen is not null and o2.id is null)
    group by s.attempt_id, s.user_id, s.submitted_at, s.started_at""")}


@query("attempt_scores", oracle("scored", """select attempt_id, user_id, cast(max_score as double) as max_score,
    cast(score as double) as score, correct_count, wrong_count, unanswered_count, percentage, time_spent_seconds from scored""", SCORED))
def attempt_scores(t):
    return double(scored(t), "max_score", "score", "percentage").select(
        "attempt_id", "user_id", "max_score", "score", "correct_count", "wrong_count", "unanswered_count", "percentage",
        "time_spent_seconds")


@query("bad_option_selections", oracle("sheet", """select s.attempt_id, s.question_id, s.chosen as selected_option_id from sheet s
    where s.chosen is not null and not exists (select 1 from options o where o.id = s.chosen and o.question_id = s.question_id)""", SCORED))
def bad_option_selections(t):
    attempts, _, given = quiz_of_attempt(t)
    mine = given.join(attempts.select(F.col("id").alias("attempt_id")), "attempt_id", "left_semi")
    return learning.bad_selections(mine, t.options).select("attempt_id", "question_id", "selected_option_id")


@query("foreign_answers", oracle("answers attempts questions", """select x.attempt_id, x.question_id from answers x
    join attempts a on a.id = x.attempt_id where not exists (select 1 from questions q where q.id = x.question_id and q.quiz_id = a.quiz_id)"""))
def foreign_answers(t):
    qq = t.questions.select("quiz_id", F.col("id").alias("question_id"))
    return learning.foreign_answers(t.answers, t.attempts, qq).select("attempt_id", "question_id")


# ------------------------------------------------------------------------------------ A3, J2, A8, W1-W5
def mastery(t):
    rows = (t.answers.join(t.attempts.filter("status = 'SUBMITTED'").selectExpr("id as attempt_id", "user_id", "quiz_id", "submitted_at"), "attempt_id")
            .join(t.quizzes.selectExpr("id as quiz_id", "subject_id"), "quiz_id")
            .join(t.questions.selectExpr("id as question_id", "source_chunk_id as chunk_id"), "question_id")
            .join(t.chunks.selectExpr("id as chunk_id", "section_id"), "chunk_id"))
    return learning.topic_mastery(rows.select(
        "user_id", "subject_id", "section_id", "is_correct", F.col("submitted_at").alias("practiced_at"),
        F.struct("attempt_id", "question_id").alias("tie")))


MASTERY = {"mastery": (("answers", "attempts", "quizzes", "questions", "chunks"), """
    select a.user_id, c.section_id, arg_min(z.subject_id, (a.submitted_at, a.id, q.id)) as subject_id, count(*) as attempts,
      count(*) filter (where x.is_correct) as correct_answers, count(*) filter (where not x.is_correct) as wrong_answers,
      cast(round_even(count(*) filter (where x.is_correct) * 100.0 / count(*), 2) as double) as mastery_score, max(a.submitted_at) as last_practiced_at
    from answers x join attempts a on a.id = x.attempt_id join quizzes z on z.id = a.quiz_id join questions q on q.id = x.question_id
    join chunks c on c.id = q.source_chunk_id where a.status = 'SUBMITTED' and z.subject_id is not null and c.section_id <> 0
    group by a.user_id, c.section_id"""),
    "scope": (("answers", "attempts", "questions", "chunks", "ldocs"), """select distinct a.user_id, d.subject_id from answers x
    join attempts a on a.id = x.attempt_id join questions q on q.id = x.question_id join chunks c on c.id = q.source_chunk_id
    join ldocs d on d.id = c.document_id where d.subject_id is not null"""),
    "topics": (("scope", "mastery", "ldocs", "sections"), """select p.user_id, p.subject_id, s.id as section_id, s.title, s.section_order,
      coalesce(m.attempts, 0) as attempts, coalesce(m.correct_answers, 0) as correct_answers, coalesce(m.wrong_answers, 0) as wrong_answers,
      coalesce(m.mastery_score, 0) as mastery_score, m.last_practiced_at,
      case when coalesce(m.attempts, 0) < 2 then 'NOT_ENOUGH_DATA' when m.mastery_score < 60 then 'WEAK'
        when m.mastery_score < 80 then 'DEVELOPING' else 'STRONG' end as status
    from scope p join ldocs d on d.subject_id = p.subject_id and d.status = 'READY' join sections s on s.document_id = d.id
    left join mastery m on m.user_id = p.user_id and m.subject_id = p.subject_id and m.section_id = s.id"""),
    "spaced0": (("topics",), f"""select *, case status when 'NOT_ENOUGH_DATA' then 0 when 'WEAK' then case when mastery_score < 40 then 1 else 2 end
      when 'DEVELOPING' then case when mastery_score < 70 then 2 else 3 end
      else case when mastery_score >= 95 and attempts >= 4 then 14 when mastery_score >= 90 then 10 else 7 end end as interval_days,
      timestamp '{AS_OF}' as t0 from topics"""),
    "spaced1": (("spaced0",), """select *, case when last_practiced_at is null then t0 else last_practiced_at + to_days(cast(interval_days as integer)) end as next_review_at from spaced0"""),
    "spaced": (("spaced1",), """select *, case when last_practiced_at is null then 'NEW' when next_review_at <= t0 then 'DUE'
      when cast(next_review_at as date) = cast(t0 as date) then 'DUE_TODAY' else 'UPCOMING' end as due_status,
      round_even(case status when 'WEAK' then 400 when 'DEVELOPING' then 300 when 'NOT_ENOUGH_DATA' then 250 else 100 end
        + greatest(0, 100 - mastery_score) + 40 * greatest(0, 2 - attempts) + case when next_review_at <= t0 then 100 else 0 end
        + 10 * least(30, greatest(0, cast(t0 as date) - cast(next_review_at as date))), 2) as priority_score,
      greatest(cast(t0 as date), cast(next_review_at as date)) as scheduled_date, next_review_at <= t0 as is_due from spaced1""")}


@query("topic_mastery", oracle("mastery", "select * from mastery", MASTERY))
def topic_mastery(t):
    return double(mastery(t), "mastery_score")


def topics(t):
    scope = (t.answered.join(t.attempts.selectExpr("id as attempt_id", "user_id"), "attempt_id")
             .join(t.questions.selectExpr("id as question_id", "source_chunk_id as chunk_id"), "question_id")
             .join(t.chunks.selectExpr("id as chunk_id", "document_id"), "chunk_id")
             .join(t.documents.filter("subject_id is not null").selectExpr("id as document_id", "subject_id"), "document_id")
             .select("user_id", "subject_id").distinct())
    return learning.topic_mastery_list(t.sections, t.documents, mastery(t), scope)


@query("topic_mastery_list", oracle("topics", "select * from topics", MASTERY))
def topic_mastery_list(t):
    return topics(t)


@query("mastery_summary", oracle("topics", """select user_id, subject_id, count(*) as total_topics,
    count(*) filter (where status = 'WEAK') as weak_topics, count(*) filter (where status = 'DEVELOPING') as developing_topics,
    count(*) filter (where status = 'STRONG') as strong_topics,
    count(*) filter (where status = 'NOT_ENOUGH_DATA') as not_enough_data_topics from topics group by 1, 2""", MASTERY))
def mastery_summary(t):
    return learning.mastery_summary(topics(t))


@query("practice_recommendations", oracle("topics", """
select r.user_id, r.subject_id, r.section_id, r.status, r.rank, k.skipped_strong_topics,
  case r.status when 'WEAK' then 'Mastery is below 60%, so this topic should be reviewed first.'
    when 'DEVELOPING' then 'Mastery is ' || printf('%.2f', r.mastery_score) || '%. The learner has basic understanding but still needs more practice to reach STRONG.'
    else 'Only ' || r.attempts || ' attempt(s) are available. More practice is needed to measure mastery reliably.' end as reason
from (select *, row_number() over (partition by user_id, subject_id order by
    case status when 'WEAK' then 0 when 'DEVELOPING' then 1 else 2 end,
    case when status = 'NOT_ENOUGH_DATA' then attempts else mastery_score end,
    case when status = 'NOT_ENOUGH_DATA' then 0 else -attempts end, section_id) as rank from topics where status <> 'STRONG') r
join (select user_id, subject_id, count(*) filter (where status = 'STRONG') as skipped_strong_topics from topics group by 1, 2) k
  on k.user_id = r.user_id and k.subject_id = r.subject_id""", MASTERY))
def practice_recommendations(t):
    return planning.recommend(topics(t)).select("user_id", "subject_id", "section_id", "status", "rank", "skipped_strong_topics", "reason")


@query("weak_topics", oracle("topics", """select user_id, subject_id, section_id, mastery_score, attempts,
    row_number() over (partition by user_id, subject_id order by mastery_score, attempts desc, section_id) as rank
    from topics where status = 'WEAK'""", MASTERY))
def weak_topics(t):
    return planning.weak_topics(topics(t)).select("user_id", "subject_id", "section_id", "mastery_score", "attempts", "rank")


@query("spaced_plan", oracle("spaced", """select user_id, subject_id, section_id, status, interval_days, next_review_at, due_status, priority_score,
    scheduled_date, is_due, row_number() over (partition by user_id, subject_id, scheduled_date order by priority_score desc, section_id) as day_rank,
    case status when 'NOT_ENOUGH_DATA' then 'Only ' || attempts || ' attempt(s) are available. Another practice session is scheduled to obtain enough mastery evidence.'
      when 'WEAK' then 'Mastery is ' || printf('%.2f', mastery_score) || '%. Review again after ' || interval_days || ' day(s) because this topic is WEAK.'
      when 'DEVELOPING' then 'Mastery is ' || printf('%.2f', mastery_score) || '%. Review after ' || interval_days || ' day(s) to reinforce the topic.'
      else 'Mastery is ' || printf('%.2f', mastery_score) || '%. The topic is STRONG, so its review interval is expanded to ' || interval_days || ' day(s).' end as reason
    from spaced where scheduled_date <= cast(t0 as date) + 6""", MASTERY))
def spaced_plan(t):
    return planning.spaced_plan(topics(t), as_of(), 7).select(
        "user_id", "subject_id", "section_id", "status", "interval_days", "next_review_at", "due_status", "priority_score",
        "scheduled_date", "is_due", "day_rank", "reason")


@query("plan_calendar", oracle("spaced", f"""select d.user_id, d.subject_id, d.scheduled_date, count(s.section_id) as item_count
    from (select distinct user_id, subject_id, date '{AS_OF[:10]}' + n as scheduled_date from topics,
      (select cast(unnest(range(7)) as integer) as n)) d
    left join spaced s on s.user_id = d.user_id and s.subject_id = d.subject_id and s.scheduled_date = d.scheduled_date
    group by 1, 2, 3""", MASTERY))
def plan_calendar(t):
    return planning.plan_calendar(topics(t), as_of(), 7)


@query("plan_totals", oracle("spaced", """select user_id, subject_id, count(*) as total_topics,
    count(*) filter (where scheduled_date <= cast(t0 as date) + 6) as scheduled_topics, count(*) filter (where is_due) as due_topics,
    count(*) filter (where scheduled_date > cast(t0 as date) + 6) as deferred_topics from spaced group by 1, 2""", MASTERY))
def plan_totals(t):
    return planning.plan_totals(topics(t), as_of(), 7)


@query("due_sections", oracle("spaced", """select user_id, subject_id, section_id, priority_score, pick from (select *,
    row_number() over (partition by user_id, subject_id order by priority_score desc, section_id) as pick from spaced where is_due)
    where pick <= 1 + subject_id % 3""", MASTERY))
def due_sections(t):
    return planning.due_sections(topics(t), as_of(), F.expr("1 + subject_id % 3")).select(
        "user_id", "subject_id", "section_id", "priority_score", "pick")


@query("adaptive_sections", oracle("topics", """select user_id, subject_id, section_id, status, pick from (select *,
    row_number() over (partition by user_id, subject_id order by case status when 'WEAK' then 0 when 'DEVELOPING' then 1 else 2 end,
    case when status = 'NOT_ENOUGH_DATA' then attempts else mastery_score end,
    case when status = 'NOT_ENOUGH_DATA' then 0 else -attempts end, section_id) as pick from topics where status <> 'STRONG')
    where pick <= greatest(1, subject_id % 4)""", MASTERY))
def adaptive_sections(t):
    return planning.adaptive_sections(topics(t), F.expr("subject_id % 4")).select("user_id", "subject_id", "section_id", "status", "pick")


# ------------------------------------------------------------------------------------ A4, A5, A6, A7, W6, W17, S6
ACTIVITY = {"days": ((), "select distinct user_id, cast(ts as date) as day from events"),
            "isl": (("days",), "select user_id, day, day - cast(row_number() over (partition by user_id order by day) as integer) as g from days")}

BADGES = {**SCORED, **ACTIVITY, "earned": (("scored", "isl", "reviews"), """
    select user_id, min(cast(submitted_at as date)) as earned_on, 'FIRST_QUIZ' as badge_code from scored group by 1 union all
    select user_id, min(cast(submitted_at as date)), 'PERFECT_SCORE' from scored where percentage >= 100 group by 1 union all
    select user_id, min(day), 'STREAK_7' from (select *, row_number() over (partition by user_id, g order by day) as n from isl) where n = 7 group by 1 union all
    select user_id, day, 'FLASHCARD_100' from (select user_id, cast(reviewed_at as date) as day,
      row_number() over (partition by user_id order by cast(reviewed_at as date), id) as n from reviews) where n = 100""")}

# The rewards are written here once more, apart from the query's own table.
DAILY = {**BADGES, "xp": (("scored", "reviews", "earned"), """select user_id, 10 + 2 * correct_count as amount, 'QUIZ_ATTEMPT' as source_type,
      attempt_id as source_id, submitted_at as "at" from scored union all
      select user_id, 2, 'FLASHCARD_REVIEW', id, reviewed_at from reviews union all
      select user_id, case badge_code when 'FIRST_QUIZ' then 50 when 'STREAK_7' then 150 else 100 end, 'BADGE',
        case badge_code when 'FIRST_QUIZ' then 1 when 'PERFECT_SCORE' then 2 when 'STREAK_7' then 3 else 4 end, cast(earned_on as timestamp) from earned""")}


def xp_rows(t):
    return learning.xp_events(scored(t), t.reviews, badges(t))


@query("daily_stats", oracle("scored reviews xp", """select user_id, activity_date, sum(qa) as quiz_attempts, sum(q) as questions_answered,
    sum(c) as correct_answers, sum(f) as flashcards_reviewed, sum(x) as xp_earned from (
    select user_id, cast(submitted_at as date) as activity_date, 1 as qa, correct_count + wrong_count + unanswered_count as q,
      correct_count as c, 0 as f, 0 as x from scored union all
    select user_id, cast(reviewed_at as date), 0, 0, 0, 1, 0 from reviews union all
    select user_id, cast("at" as date), 0, 0, 0, 0, amount from xp) group by 1, 2""", DAILY))
def daily_stats(t):
    a = scored(t).select("user_id", F.to_date("submitted_at").alias("activity_date"),
                         (F.col("correct_count") + F.col("wrong_count") + F.col("unanswered_count")).alias("questions"),
                         F.col("correct_count").alias("correct"))
    r = t.reviews.select("user_id", F.to_date("reviewed_at").alias("activity_date"))
    x = xp_rows(t).select("user_id", F.to_date("at").alias("activity_date"), "amount")
    return learning.daily_stats(a, r, x)


@query("merged_review_counts", oracle("reviews", """select user_id, flashcard_id, count(*) as reviews, max(rating) as best_rating
    from reviews group by 1, 2"""))
def merged_review_counts(t):
    """The aggregate of one half of the reviews merged with that of the other half."""
    r = t.reviews.select("user_id", "flashcard_id", F.lit(1).cast("long").alias("reviews"), F.col("rating").alias("best_rating"), "id")
    key = ["user_id", "flashcard_id"]
    part = lambda bit: r.filter(F.expr(f"id % 2 = {bit}")).groupBy(*key).agg(
        F.sum("reviews").alias("reviews"), F.max("best_rating").alias("best_rating"))
    return learning.merge_aggregate(part(0), part(1), key, ["reviews"], ["best_rating"])


@query("subject_progress", oracle("scored quizzes attempts", """select user_id, subject_id, max(n) as quizzes_completed,
    arg_max(avg_cents, n) / 100.0::double as average_score, arg_max(submitted_at, n) as last_activity_at from steps group by 1, 2""".replace(
    "from steps", "from (select * from steps)"), {**SCORED,
    "prog": (("scored", "attempts", "quizzes"), """select s.user_id, z.subject_id, s.submitted_at, s.attempt_id,
      cast(round(s.percentage * 100) as bigint) as pct, row_number() over (partition by s.user_id, z.subject_id order by s.submitted_at, s.attempt_id) as n
      from scored s join attempts a on a.id = s.attempt_id join quizzes z on z.id = a.quiz_id where z.subject_id is not null"""),
    }).replace("with ", "with recursive ", 1).replace(" select user_id, subject_id, max(n)", """, prog as materialized (select s.user_id, z.subject_id, s.submitted_at, s.attempt_id,
      cast(round(s.percentage * 100) as bigint) as pct, row_number() over (partition by s.user_id, z.subject_id order by s.submitted_at, s.attempt_id) as n
      from scored s join attempts a on a.id = s.attempt_id join quizzes z on z.id = a.quiz_id where z.subject_id is not null),
    steps as (select user_id, subject_id, n, pct as avg_cents, submitted_at from prog where n = 1 union all
      select p.user_id, p.subject_id, p.n, (2 * (s.avg_cents * (p.n - 1) + p.pct) + p.n) // (2 * p.n), p.submitted_at
      from steps s join prog p on p.user_id = s.user_id and p.subject_id = s.subject_id and p.n = s.n + 1)
    select user_id, subject_id, max(n)""", 1))
def subject_progress(t):
    quiz = t.attempts.selectExpr("id as attempt_id", "quiz_id").join(t.quizzes.selectExpr("id as quiz_id", "subject_id"), "quiz_id")
    return learning.subject_progress(scored(t).drop("quiz_id").join(quiz, "attempt_id"))


@query("xp_state", oracle("xp", """select user_id, sum(amount) as xp_total,
    cast(greatest(1, floor(sqrt(sum(amount) / 100.0)) + 1) as integer) as level_no from xp group by 1""", DAILY))
def xp_state(t):
    return learning.xp_state(xp_rows(t).withColumn("id", F.struct("source_type", "source_id")))


@query("xp_with_deductions", oracle("xp", """, signed as (select user_id, sum(case when source_id % 3 = 0 then -4 * amount else amount end)
      over (partition by user_id order by "at", source_type, source_id) as run from xp), final as (
      select user_id, sum(case when source_id % 3 = 0 then -4 * amount else amount end) as s from xp group by 1)
    select f.user_id, f.s - least(0, min(g.run)) as xp_total,
      cast(greatest(1, floor(sqrt((f.s - least(0, min(g.run))) / 100.0)) + 1) as integer) as level_no
    from final f join signed g on g.user_id = f.user_id group by f.user_id, f.s""", DAILY))
def xp_with_deductions(t):
    """A6 with negative amounts: the total never falls below zero."""
    x = xp_rows(t).withColumn("amount", F.when(F.expr("source_id % 3 = 0"), F.col("amount") * -4).otherwise(F.col("amount")))
    return learning.xp_state(x.withColumn("id", F.struct("source_type", "source_id")))


@query("recent_xp", oracle("xp", """select * from (select *, row_number() over (partition by user_id order by "at" desc, source_id desc, source_type desc) as pos from xp) where pos <= 50""", DAILY))
def recent_xp(t):
    return planning.recent_xp(xp_rows(t), 50)


@query("study_streaks", oracle("isl", """select user_id, arg_max(n, last) as current_streak, max(n) as longest_streak, max(last) as last_study_date
    from (select user_id, g, count(*) as n, max(day) as last from isl group by 1, 2) group by 1""", ACTIVITY))
def study_streaks(t):
    return learning.streaks(t.raw("events").select("user_id", F.to_date("ts").alias("day")))


def badges(t):
    s = scored(t).select("user_id", "percentage", F.to_date("submitted_at").alias("day"))
    r = t.reviews.select("user_id", F.to_date("reviewed_at").alias("day"), "id")
    return learning.earn_badges(s, r, t.raw("events").select("user_id", F.to_date("ts").alias("day")))


@query("badges_earned", oracle("earned", "select * from earned", BADGES))
def badges_earned(t):
    return badges(t)


@query("badge_list", oracle("earned", """select e.user_id, e.badge_code, e.earned_on,
    case e.badge_code when 'FIRST_QUIZ' then 50 when 'PERFECT_SCORE' then 100 when 'STREAK_7' then 150 else 100 end as xp_reward
    from earned e""", BADGES))
def badge_list(t):
    defs = t.spark.createDataFrame(list(learning.BADGES), "code string, xp_reward int")
    return learning.earned_badges(badges(t), defs)


# ------------------------------------------------------------------------------------ U1, A11, J5, J6
REVIEW_STEPS = """with recursive reviews as (""" + oracle("reviews", "select * from reviews").split("(", 1)[1].rsplit(")", 1)[0] + """),
    r as materialized (select *, row_number() over (partition by user_id, flashcard_id order by reviewed_at, id) as n from reviews),
    f as (select user_id, flashcard_id, n, id as review_id, reviewed_at, rating, 0::bigint as previous_interval,
        case rating when 3 then 4 else 1 end::bigint as next_interval, 250 as pe,
        case rating when 0 then 230 when 1 then 235 when 2 then 250 else 265 end as ne,
        case rating when 0 then 0 else 1 end as repetitions, case rating when 0 then 1 else 0 end as lapse_count from r where n = 1
      union all
      select r.user_id, r.flashcard_id, r.n, r.id, r.reviewed_at, r.rating, f.next_interval,
        case r.rating when 0 then 1 when 1 then greatest(1, round_even(greatest(1, f.next_interval) * 1.2::double, 0))
          when 2 then case f.repetitions + 1 when 1 then 1 when 2 then 3 else greatest(1, round_even(greatest(1, f.next_interval) * (f.ne / 100.0::double), 0)) end
          else case f.repetitions + 1 when 1 then 4 else greatest(2, round_even(greatest(1, f.next_interval) * (f.ne / 100.0::double) * 1.3::double, 0)) end end::bigint,
        f.ne, case r.rating when 0 then greatest(130, f.ne - 20) when 1 then greatest(130, f.ne - 15) when 2 then f.ne else least(350, f.ne + 15) end,
        case r.rating when 0 then 0 else f.repetitions + 1 end, f.lapse_count + case r.rating when 0 then 1 else 0 end
      from f join r on r.user_id = f.user_id and r.flashcard_id = f.flashcard_id and r.n = f.n + 1),
    prog as (select user_id, flashcard_id, arg_max(repetitions, n) as repetitions, arg_max(next_interval, n) as interval_days,
      arg_max(ne / 100.0::double, n) as ease_factor, arg_max(lapse_count, n) as lapse_count, arg_max(rating, n) as last_rating,
      arg_max(reviewed_at + to_days(cast(next_interval as integer)), n) as next_review_at from f group by 1, 2)
"""


@query("review_history", REVIEW_STEPS + """select review_id, user_id, flashcard_id, rating, previous_interval, next_interval, pe / 100.0::double as previous_ease,
    ne / 100.0::double as next_ease, repetitions, lapse_count, reviewed_at, reviewed_at + to_days(cast(next_interval as integer)) as next_review_at from f""")
def review_history(t):
    return rv.review_schedule(t.reviews)


@query("review_progress", REVIEW_STEPS + "select * from prog")
def review_progress(t):
    return rv.review_progress(rv.review_schedule(t.reviews))


@query("due_cards", REVIEW_STEPS + f"""select p.user_id, p.flashcard_id, p_partkey // 10 as deck_id, p_name as front_text, p.interval_days, p.next_review_at
    from prog p join part on p_partkey = p.flashcard_id where p.next_review_at <= timestamp '{AS_OF_CARDS}'""")
def due_cards(t):
    p = rv.review_progress(rv.review_schedule(t.reviews))
    return learning.due_cards_view(p, t.cards, as_of(AS_OF_CARDS)).select(
        "user_id", "flashcard_id", "deck_id", "front_text", "interval_days", "next_review_at")


@query("due_queue", REVIEW_STEPS + f"""select user_id, flashcard_id, next_review_at, queue_pos from (
    select p_partkey // 10 as user_id, p_partkey as flashcard_id, p.next_review_at,
      row_number() over (partition by p_partkey // 10 order by p.next_review_at asc nulls first, p_partkey) as queue_pos
    from part left join prog p on p.user_id = p_partkey // 10 and p.flashcard_id = p_partkey
    where p.next_review_at is null or p.next_review_at <= timestamp '{AS_OF_CARDS}') where queue_pos <= 50""")
def due_queue(t):
    p = rv.review_progress(rv.review_schedule(t.reviews))
    return learning.due_queue(t.decks, t.cards, p, as_of(AS_OF_CARDS), 50).select("user_id", "flashcard_id", "next_review_at", "queue_pos")


# ------------------------------------------------------------------------------------ J3, J4, A10, U-5
@query("public_resources", oracle("posts users toggles", """, live as (select post_id, user_id, kind from toggles group by 1, 2, 3 having count(*) % 2 = 1),
    n as (select post_id, count(*) filter (where kind = 'LIKE') as l, count(*) filter (where kind = 'SAVE') as s from live group by 1)
    select p.id as post_id, p.owner_id, u.full_name as owner_name, p.quiz_id, p.flashcard_deck_id, p.title, p.published_at,
      coalesce(n.l, 0) as like_count, coalesce(n.s, 0) as save_count
    from posts p join users u on u.id = p.owner_id left join n on n.post_id = p.id where p.status = 'PUBLISHED'"""))
def public_resources(t):
    live = learning.toggle_state(t.toggles)
    return learning.public_resources(t.posts, t.users, live.filter("kind = 'LIKE'"), live.filter("kind = 'SAVE'"))


@query("toggle_state", oracle("toggles", """select post_id, kind, count(*) as active from (select post_id, user_id, kind from toggles
    group by 1, 2, 3 having count(*) % 2 = 1) group by 1, 2"""))
def toggle_counts(t):
    return learning.toggle_state(t.toggles).groupBy("post_id", "kind").agg(F.count(F.lit(1)).alias("active"))


@query("attempt_summary", oracle("attempts quizzes", """select a.id as attempt_id, a.user_id, a.quiz_id, z.title as quiz_title, a.status,
    a.started_at, a.submitted_at from attempts a join quizzes z on z.id = a.quiz_id"""))
def attempt_summary(t):
    return learning.attempt_summary(t.attempts, t.quizzes).select(
        "attempt_id", "user_id", "quiz_id", "quiz_title", "status", "started_at", "submitted_at")


FORKS = {"forks": (("posts", "toggles"), """select distinct t.post_id, t.user_id, p.quiz_id, p.flashcard_deck_id, t.post_id || ':' || t.user_id as fork_key
    from toggles t join posts p on p.id = t.post_id where t.kind = 'SAVE' and p.status = 'PUBLISHED'""")}


def fork_requests(t):
    return t.toggles.filter("kind = 'SAVE'").select("post_id", "user_id")


@query("forked_quizzes", oracle("forks quizzes", """select f.fork_key, f.user_id as owner_id, f.quiz_id as source_quiz_id,
    z.title || ' (fork)' as title, 'DRAFT' as status, 'PRIVATE' as visibility, cast(null as bigint) as subject_id, 'About ' || z.id as description,
    case z.id % 2 when 0 then 'EXAM' else 'PRACTICE' end as mode from forks f join quizzes z on z.id = f.quiz_id""", FORKS))
def forked_quizzes(t):
    return learning.fork_quizzes(fork_requests(t), t.posts, described(t.quizzes), t.questions, t.options)[0]


def described(df):
    """Columns that a fork copies, filled from the id."""
    return df.withColumn("description", F.concat(F.lit("About "), "id")).withColumn("mode", F.expr("case id % 2 when 0 then 'EXAM' else 'PRACTICE' end"))


@query("forked_questions", oracle("forks questions", """select f.fork_key, f.fork_key || ':' || q.id as question_key, q.question_order,
    q.question_text, q.explanation, q.difficulty, cast(q.points as double) as points, cast(null as bigint) as source_chunk_id
    from forks f join questions q on q.quiz_id = f.quiz_id""", FORKS))
def forked_questions(t):
    q = learning.fork_quizzes(fork_requests(t), t.posts, t.quizzes, t.questions, t.options)[1]
    return double(q, "points").select("fork_key", "question_key", "question_order", "question_text", "explanation", "difficulty", "points",
                                      "source_chunk_id")


@query("forked_options", oracle("forks questions options", """select f.fork_key || ':' || q.id as question_key, o.option_key, o.option_text, o.is_correct,
    o.position from forks f join questions q on q.quiz_id = f.quiz_id join options o on o.question_id = q.id""", FORKS))
def forked_options(t):
    return learning.fork_quizzes(fork_requests(t), t.posts, t.quizzes, t.questions, t.options)[2]


@query("forked_decks", oracle("forks", """select f.fork_key, f.user_id as owner_id, f.flashcard_deck_id as source_deck_id, d.title || ' (fork)' as title,
    'DRAFT' as status, 'PRIVATE' as visibility, 'About ' || d.id as description, case d.id % 2 when 0 then 'EXAM' else 'PRACTICE' end as mode
    from forks f join (select p_partkey // 10 as id, min(p_name) as title from part group by 1) d on d.id = f.flashcard_deck_id where f.quiz_id is null""", FORKS))
def forked_decks(t):
    return learning.fork_decks(fork_requests(t), t.posts, described(t.decks), t.cards)[0]


@query("forked_cards", oracle("forks cards", """select f.fork_key, c.card_order, c.front_text, c.back_text, cast(null as bigint) as source_chunk_id from forks f
    join cards c on c.deck_id = f.flashcard_deck_id where f.quiz_id is null""", FORKS))
def forked_cards(t):
    return learning.fork_decks(fork_requests(t), t.posts, t.decks, t.cards)[1]


# ------------------------------------------------------------------------------------ J7, J13, J14, W13, S7
@query("accessible_subjects", oracle("subjects members", """select distinct user_id, subject_id from (
    select owner_id as user_id, id as subject_id from subjects union all
    select m.user_id, m.subject_id from members m where m.subject_id in (select id from subjects))"""))
def accessible_subjects(t):
    return learning.accessible_subjects(t.subjects, t.members)


@query("accessible_subject_rows", oracle("subjects members", """select u.user_id, count(*) as rows from (select distinct user_id from members union
    select owner_id from subjects) u join subjects s on true left join members m on m.subject_id = s.id
    where s.owner_id = u.user_id or m.user_id = u.user_id group by 1"""))
def accessible_subject_rows(t):
    return learning.accessible_subject_rows(t.subjects, t.members)


UNITS = {"units": (("ldocs", "sections"), """select d.id as document_id, d.owner_id, d.subject_id, d.original_name, d.created_on, s.id as section_id,
    s.section_order, case when s.id is null then d.original_name when coalesce(s.title, '') <> '' then s.title
      else 'Section ' || (s.section_order + 1) end as label from ldocs d left join sections s on s.document_id = d.id where d.status = 'READY'"""),
    "w0": (("plans", "units"), """select p.*, u.document_id, u.section_id, u.label, row_number() over (partition by p.plan_id order by u.created_on, u.document_id,
      coalesce(u.section_order, 0), coalesce(u.section_id, 0)) - 1 as r, greatest(15, least(45, case when daily_minutes // 2 = 0 then 30 else daily_minutes // 2 end)) as unit,
      (exam_date - start_date) + 1 as days from plans p join units u on u.owner_id = p.user_id and u.subject_id = p.subject_id"""),
    "w1": (("w0",), """select *, case when days > 2 then days - 1 else days end as sd, daily_minutes // unit as per_day from w0"""),
    "w2": (("w1",), """select *, case when per_day >= 1 then least(sd - 1, r // per_day) else least(sd - 1, r + 1) end as day from w1"""),
    "tasks": (("w2",), """select plan_id, document_id, section_id, start_date + cast(day as integer) as task_date, 'STUDY' as task_type, 'Học: ' || label as title,
      unit as estimated_minutes, row_number() over (partition by plan_id, day order by r) - 1 as sort_order from w2 union all
      select plan_id, null, null, exam_date, 'REVIEW', 'Ôn tập tổng hợp trước kỳ thi', daily_minutes, 0 from plans
      where exam_date > start_date and plan_id in (select plan_id from w2)""")}


def tasks(t):
    return planning.study_plan(t.plans, learning.study_units(t.documents, t.sections))


@query("study_units", oracle("units", "select * from units", UNITS))
def study_units(t):
    return learning.study_units(t.documents, t.sections)


@query("study_plan_tasks", oracle("tasks", "select * from tasks", UNITS))
def study_plan_tasks(t):
    return tasks(t)


@query("plan_tasks", oracle("tasks plans", """select k.plan_id, p.user_id, k.task_date, k.task_type, k.title, k.sort_order
    from tasks k join plans p on p.plan_id = k.plan_id""", UNITS))
def plan_tasks(t):
    return learning.plan_tasks(t.plans, tasks(t)).select("plan_id", "user_id", "task_date", "task_type", "title", "sort_order")


# ------------------------------------------------------------------------------------ A9, J9, W14, P9, P10, K3
@query("chunk_set_audit", oracle("chunks", "select chunk_set_id, chunking_algorithm, is_active, count(*) as chunk_count from chunks group by 1, 2, 3"))
def chunk_set_audit(t):
    return learning.chunk_set_audit(t.chunks)


@query("chunks_without_embedding", oracle("chunks vectors", "select id, document_id from chunks where is_active and id not in (select chunk_id from vectors)"))
def chunks_without_embedding(t):
    return learning.missing_embeddings(t.chunks, t.vectors).select("id", "document_id")


@query("active_chunk_sets", oracle("chunks", """select c.id, c.document_id, c.chunk_set_id, c.chunk_set_id = m.s as is_active from chunks c
    join (select document_id, arg_max(chunk_set_id, (id, chunk_set_id)) as s from chunks group by 1) m on m.document_id = c.document_id"""))
def active_chunk_sets(t):
    return planning.active_chunks(t.chunks.drop("is_active"), F.col("id")).select("id", "document_id", "chunk_set_id", "is_active")


@query("recent_notifications", oracle("notifications", """select id, user_id, notification_type, title, created_at, pos from (select *,
    row_number() over (partition by user_id order by created_at desc, id desc) as pos from notifications where not is_read) where pos <= 100"""))
def recent_notifications(t):
    return lists.recent_notifications(t.notifications, True, 100).select("id", "user_id", "notification_type", "title", "created_at", "pos")


@query("quiz_page", oracle("quizzes", """select id, owner_id, title, pos, total from (select *, row_number() over (partition by owner_id order by created_at desc, id desc) as pos,
    count(*) over (partition by owner_id) as total from quizzes) where pos > 2 and pos <= 5"""))
def quiz_page(t):
    return lists.page(t.quizzes, ["owner_id"], [F.desc("created_at"), F.desc("id")], 3, 2).select("id", "owner_id", "title", "pos", "total")


@query("conversation_messages", oracle("messages", """select conversation_id, turn, role, content, child_no from (select *,
    row_number() over (partition by conversation_id order by turn) as child_no from messages)"""))
def conversation_messages(t):
    return lists.ordered_children(t.messages, "conversation_id", [F.asc("turn")], [F.floor(F.col("turn") / 4096)])


@query("chunk_listing", oracle("chunks", """select document_id, id, chunk_index, child_no from (select *, row_number() over (partition by document_id
    order by chunk_index) as child_no from chunks where is_active)"""))
def chunk_listing(t):
    return lists.ordered_children(t.chunks.filter("is_active"), "document_id", [F.asc("chunk_index")], [F.floor(F.col("chunk_index") / 4096)]).select(
        "document_id", "id", "chunk_index", "child_no")


# ------------------------------------------------------------------------------------ W16
@query("distinct_questions", oracle("questions", """, n as (select *, regexp_replace(regexp_replace(lower(trim(regexp_replace(question_text, '[0-9]+$', ''))), '\\s+', ' ', 'g'), '[.!?;,:\\-]+$', '') as k
    from questions), used as (select distinct quiz_id, k from n where question_order = 5)
    select quiz_id, id, question_order from (select *, row_number() over (partition by quiz_id, k order by question_order) as rn from n where question_order < 5) f
    where rn = 1 and not exists (select 1 from used u where u.quiz_id = f.quiz_id and u.k = f.k)"""))
def distinct_questions(t):
    q = t.questions.withColumn("question_text", F.regexp_replace("question_text", "[0-9]+$", ""))
    return planning.dedupe_questions(q.filter("question_order < 5"), q.filter("question_order = 5")).select("quiz_id", "id", "question_order")
