"""Hand-computed numeric cases, ranks on skewed keys, and stream = batch."""

import datetime as dt

from pyspark.sql import functions as F
import pytest

from studyloom.functions import mastery as ms
from studyloom.operators import access, learning as ln, lists, numbering as nb, planning as pl, retrieval as rt, reviews as rv
from studyloom.sources import files, sinks
from studyloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1, 12)


def reviews(spark, ratings, user=1, card=1):
    return spark.createDataFrame([(i, user, card, r, T0 + dt.timedelta(days=i)) for i, r in enumerate(ratings)],
                                 "id long, user_id long, flashcard_id long, rating int, reviewed_at timestamp")


@pytest.mark.parametrize("ratings,intervals,eases", [((2, 2, 2), [1, 3, 8], [2.5, 2.5, 2.5]), ((3, 0, 1), [4, 1, 1], [2.65, 2.45, 2.3])])
def test_review_steps(spark, ratings, intervals, eases):
    out = rv.review_schedule(reviews(spark, ratings)).orderBy("review_id").collect()
    assert [r.next_interval for r in out] == intervals and [r.next_ease for r in out] == eases
    last = rv.review_progress(rv.review_schedule(reviews(spark, ratings))).first()
    assert last.interval_days == intervals[-1] and last.next_review_at == T0 + dt.timedelta(days=2 + intervals[-1])


@pytest.mark.parametrize("attempts,score,status", [(1, 100.0, "NOT_ENOUGH_DATA"), (2, 59.99, "WEAK"), (2, 60.0, "DEVELOPING"),
                                                   (2, 79.99, "DEVELOPING"), (2, 80.0, "STRONG")])
def test_mastery_class(value, attempts, score, status):
    assert value(ms.mastery_class, attempts, score) == status


@pytest.mark.parametrize("status,score,attempts,days", [("WEAK", 39.99, 2, 1), ("WEAK", 40.0, 2, 2), ("DEVELOPING", 69.99, 2, 2),
                                                        ("DEVELOPING", 70.0, 2, 3), ("STRONG", 89.99, 9, 7), ("STRONG", 90.0, 9, 10),
                                                        ("STRONG", 95.0, 3, 10), ("STRONG", 95.0, 4, 14), ("NOT_ENOUGH_DATA", 0.0, 0, 0)])
def test_interval(value, status, score, attempts, days):
    assert value(ms.interval_days, status, score, attempts) == days


def test_priority(spark):
    now = F.lit(T0)
    got = spark.range(1).select(ms.priority(F.lit("WEAK"), F.lit(50.0), F.lit(2), F.lit(T0 - dt.timedelta(days=3)), now).alias("p")).first().p
    assert got == 580.0


@pytest.mark.parametrize("xp,level", [(0, 1), (99, 1), (100, 2), (399, 2), (400, 3)])
def test_level(value, xp, level):
    assert value(ms.level, xp) == level


def test_running_mean_rounds_each_step(spark):
    df = spark.createDataFrame([(1, 1, 1, T0, 50.0), (1, 1, 2, T0 + dt.timedelta(1), 33.33)],
                               "user_id long, subject_id long, attempt_id long, submitted_at timestamp, percentage double")
    assert ln.subject_progress(df).first().average_score == 41.67


def test_unanswered_counts_as_attempt(spark):
    df = spark.createDataFrame([(1, 1, 5, c, T0, i) for i, c in enumerate((True, False, None))],
                               "user_id long, subject_id long, section_id long, is_correct boolean, practiced_at timestamp, tie int")
    r = ln.topic_mastery(df).first()
    assert (r.attempts, r.correct_answers, r.wrong_answers, float(r.mastery_score)) == (3, 1, 1, 33.33)


def test_streaks(spark):
    d = dt.date(2024, 2, 27)
    df = spark.createDataFrame([(1, d + dt.timedelta(i)) for i in (0, 1, 1, 3)], "user_id long, day date")
    r = ln.streaks(df).first()
    assert (r.current_streak, r.longest_streak, r.last_study_date) == (1, 2, d + dt.timedelta(3))


def test_xp_never_negative(spark):
    amounts = [10, -30, 5, 7, -100, 3]
    df = spark.createDataFrame([(1, a, T0 + dt.timedelta(hours=9 * i), i) for i, a in enumerate(amounts)], "user_id long, amount long, at timestamp, id long")
    total = 0
    for a in amounts:
        total = max(0, total + a)
    assert ln.xp_state(df).first().xp_total == total


def test_spread_and_allocation(spark):
    for n, q, want in ((10, 4, [0, 3, 6, 9]), (6, 3, [0, 2, 5]), (1, 5, [0]), (200, 50, None)):
        cand = spark.createDataFrame([(1, i) for i in range(min(n, 120))], "request_id long, idx long")
        req = spark.createDataFrame([(1, q)], "request_id long, question_count int")
        src = pl.spread_sample(cand, req)
        picked = [r.idx for r in src.orderBy("pick").collect()]
        assert want is None or picked == want
        slots = pl.allocate(src).collect()
        assert sorted(s.slot for s in slots) == list(range(q))
    three = spark.createDataFrame([(1, i, i, 8, 3) for i in range(3)], "request_id long, idx long, pick int, question_count int, source_count int")
    assert [r["count"] for r in pl.allocate(three).groupBy("pick").count().orderBy("pick").collect()] == [3, 3, 2]


def test_study_plan_days(spark):
    units = spark.createDataFrame([(i, 1, 1, "d", dt.date(2024, 1, 1), i * 10, 1, f"u{i}") for i in range(5)],
                                  "document_id long, owner_id long, subject_id long, original_name string, created_on date, section_id long, section_order int, label string")
    plans = spark.createDataFrame([(1, 1, 1, dt.date(2024, 2, 1), dt.date(2024, 2, 3), 60), (2, 1, 1, dt.date(2024, 2, 1), dt.date(2024, 2, 5), 10),
                                   (3, 1, 1, dt.date(2024, 2, 2), dt.date(2024, 2, 1), 60)],
                                  "plan_id long, user_id long, subject_id long, start_date date, exam_date date, daily_minutes int")
    out = pl.study_plan(plans, units).orderBy("plan_id", "task_date", "sort_order").collect()
    day = lambda r: (r.task_date - dt.date(2024, 2, 1)).days
    assert [(day(r), r.sort_order, r.estimated_minutes, r.task_type) for r in out if r.plan_id == 1] == [
        (0, 0, 30, "STUDY"), (0, 1, 30, "STUDY"), (1, 0, 30, "STUDY"), (1, 1, 30, "STUDY"), (1, 2, 30, "STUDY"), (2, 0, 60, "REVIEW")]
    assert [(day(r), r.sort_order) for r in out if r.plan_id == 2 and r.task_type == "STUDY"] == [(1, 0), (2, 0), (3, 0), (3, 1), (3, 2)]
    assert not [r for r in out if r.plan_id == 3]


def test_numbering_on_a_hot_key(spark):
    """A third of the rows share one key; ranks are those of a plain row_number and no task holds the key."""
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 0 else id % 97 + 1 end as k", "id * 7919 % 3001 as v", "id")
    got = nb.numbered(df, ["k"], [F.floor(F.col("v") / 100)], [F.col("v"), F.col("id")])
    from pyspark.sql import Window as W

    want = df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("v", "id")).cast("long"))
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0 and got.count() == 3000
    biggest = got.groupBy("k", F.floor(F.col("v") / 100)).count().agg(F.max("count")).first()[0]
    assert biggest < 100


def test_top_per_key_prunes_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 5 as k", "id")
    plan = nb.top_per_key(df, ["k"], [F.asc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_cover_density(spark):
    one = spark.range(1)
    score = lambda text, terms: one.select(rt.cover_density(rt.tokens(F.lit(text)), F.array(*map(F.lit, terms))).alias("s")).first().s
    assert score("a b", ["a", "b"]) == pytest.approx(0.1)
    assert score("a x y b", ["a", "b"]) == pytest.approx(0.1 / 3)
    assert score("a b a", ["a", "b"]) == pytest.approx(0.2)
    assert score("a a b", ["a", "b"]) == pytest.approx(0.1)
    assert score("a a", ["a", "b"]) == 0


def test_cascade_stops_at_low_vector_scores(spark):
    d = lambda r: spark.createDataFrame(r, "question_id long, chunk_id long")
    out = lists.cascade([(d([(1, 1)]), d([(1, 1), (2, 9)])), (d([(1, 5), (2, 5), (3, 5)]), d([(3, 5)])), (d([(3, 7), (4, 7)]), d([(4, 7)]))], "question_id")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1), (3, 5), (4, 7)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Chào\xa0bạn".encode() + b"\xff\xfe!")
    (tmp_path / "b.md").write_text("# x\ny")
    (tmp_path / "c.bin").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r.content for r in files.scan_text(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "Chào\xa0bạn!", "b.md": "# x\ny"}
    reg = {r.original_name: r for r in files.register_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert reg["c.bin"].reason and reg["a.txt"].status == "UPLOADED" and reg["b.md"].file_size_bytes == 5


def test_chunk_versions(spark, tmp_path):
    cols = "document_id long, chunk_set_id string, is_active boolean, superseded_at timestamp"
    old = spark.createDataFrame([(1, "a", True, None), (2, "a", True, None)], cols)
    new = sinks.publish_chunk_set(spark.createDataFrame([(1, "b", False, None)], cols), old, F.lit(T0))
    root = str(tmp_path / "chunks")
    sinks.write_chunk_version(old, root, 1)
    sinks.write_chunk_version(new, root, 2)
    got = sorted((r.document_id, r.chunk_set_id, r.is_active, r.superseded_at) for r in sinks.read_chunk_version(spark, root).collect())
    assert got == [(1, "a", False, T0), (1, "b", True, None), (2, "a", True, None)]


def test_domain_rules_cover_known_tables(spark):
    df = spark.createDataFrame([(1, "SUBMITTED", 50.0), (2, "X", 101.0), (3, None, None)], "id long, status string, percentage double")
    out = sorted((r.row_key, r.rule) for r in access.domain_violations(df, access.DOMAIN_RULES["quiz_attempts"]).collect())
    assert out == [("2", "percentage"), ("2", "status")]


# ------------------------------------------------------------------------------------ streams
def as_stream(spark, df, tmp_path, parts, order):
    """The rows of ``df`` as several parquet files, read one file per micro-batch."""
    src = str(tmp_path / "in")
    for i, low in enumerate(range(0, df.count(), parts)):
        df.orderBy(*order).offset(low).limit(parts).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def finish(stream, tmp_path, mode="update"):
    out = []
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
         .foreachBatch(lambda b, n: out.extend(b.collect())).start())
    q.awaitTermination(300)
    return out


def test_review_stream(spark, tmp_path):
    rows = [(i, i % 3, i % 2, (i * 7) % 4, T0 + dt.timedelta(hours=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, user_id long, flashcard_id long, rating int, reviewed_at timestamp")
    got = {(r.user_id, r.flashcard_id): tuple(r)[2:] for r in finish(jobs.stream_reviews(as_stream(spark, df, tmp_path, 15, ["id"])), tmp_path)}
    want = {(r.user_id, r.flashcard_id): (r.repetitions, r.interval_days, r.ease_factor, r.lapse_count)
            for r in rv.review_progress(rv.review_schedule(df)).collect()}
    assert got == want


def test_reward_stream(spark, tmp_path):
    rows = [(i % 2, 50 if i % 4 else -20, T0 + dt.timedelta(hours=11 * i), i) for i in range(30)]
    df = spark.createDataFrame(rows, "user_id long, amount long, at timestamp, id long")
    got = {r.user_id: tuple(r)[1:] for r in finish(jobs.stream_rewards(as_stream(spark, df, tmp_path, 11, ["id"])), tmp_path)}
    xp = {r.user_id: r for r in ln.xp_state(df).collect()}
    st = {r.user_id: r for r in ln.streaks(df.select("user_id", F.to_date("at").alias("day"))).collect()}
    assert got == {u: (xp[u].xp_total, xp[u].level_no, st[u].current_streak, st[u].longest_streak, st[u].last_study_date) for u in xp}


def test_daily_stream(spark, tmp_path):
    rows = [(i % 3, T0 + dt.timedelta(hours=5 * i), 1, 4, i % 5, 0, 10 + i) for i in range(40)]
    cols = "user_id long, at timestamp, quiz_attempts long, questions_answered long, correct_answers long, flashcards_reviewed long, xp_earned long"
    df = spark.createDataFrame(rows, cols)
    got = {(r.user_id, r.activity_date): tuple(r)[2:] for r in finish(jobs.stream_daily(as_stream(spark, df, tmp_path, 15, ["at"])), tmp_path)}
    sums = [c.split(" ")[0] for c in cols.split(", ")[2:]]
    want = df.groupBy("user_id", F.to_date("at").alias("d")).agg(*[F.sum(c).alias(c) for c in sums]).collect()
    assert got == {(r.user_id, r.d): tuple(r)[2:] for r in want}


def test_mastery_stream_and_merge(spark, tmp_path):
    rows = [(i % 2, i % 3 if i % 7 else None, [True, False, None][i % 3]) for i in range(50)]
    df = spark.createDataFrame(rows, "user_id long, section_id long, is_correct boolean").withColumn("n", F.monotonically_increasing_id())
    got = {(r.user_id, r.section_id): tuple(r)[2:] for r in finish(jobs.stream_mastery(as_stream(spark, df, tmp_path, 20, ["n"])), tmp_path)}
    want = {(r.user_id, r.section_id): tuple(r)[2:] for r in jobs.stream_mastery(df).collect()}
    assert got == want
    state, keys, sums = str(tmp_path / "state"), ["user_id", "section_id"], ["attempts", "correct_answers", "wrong_answers"]
    sink = jobs.merge_into(state, keys, sums, jobs.stream_mastery)

    def stored():
        return {(r.user_id, r.section_id): (r.attempts, r.correct_answers, r.wrong_answers) for r in jobs.merged_state(spark, state).collect()}

    def ended(checkpoint):
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "answers"))
        source.writeStream.option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination(300)

    df.repartition(3).write.parquet(str(tmp_path / "answers"))
    ended("first")
    assert stored() == want  # three batches of raw answers
    ended("first")
    assert stored() == want  # nothing new
    ended("second")
    assert stored() == {k: tuple(2 * n for n in v) for k, v in want.items()}  # a new stream adds to what is there
    one = spark.createDataFrame([(1, 2, True)], "user_id long, section_id long, is_correct boolean")
    before = stored()
    sink(one, 0), sink(one, 1), sink(one, 1)
    assert stored()[1, 2] == (before[1, 2][0] + 2, before[1, 2][1] + 2, before[1, 2][2])  # the repeated batch counts once


def test_chunk_stream(spark, tmp_path):
    from studyloom.operators.chunking import chunk_documents

    docs = spark.createDataFrame([(i, f"CHAPTER {i}: Title\n" + f"Some text {i}. " * 300) for i in range(4)], "document_id long, content string")
    sections = spark.createDataFrame([(9, 1, "Title", 1)], "id long, document_id long, title string, section_order int")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    jobs.stream_chunks(spark, str(tmp_path / "in"), sections, str(tmp_path / "out"), str(tmp_path / "ck"), maxFilesPerTrigger=1).awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).select("document_id", "chunk_index", "content_hash", "section_id")
    want = chunk_documents(docs, sections).select("document_id", "chunk_index", "content_hash", "section_id")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 8
