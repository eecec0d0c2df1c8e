"""Folds of hot keys by segments against stepping through them one row at a time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from studyloom.operators import learning as ln, numbering as nb, reviews as rv

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(params=[(128, 64), (100, 2)])
def small_segments(monkeypatch, request):
    """Keys of many segments, whose maps make one level and several."""
    monkeypatch.setattr(nb, "SEGMENT", request.param[0])
    monkeypatch.setattr(nb, "FAN", request.param[1])


def test_running_means_of_a_hot_key(spark, small_segments):
    rng = random.Random(1)
    rows = [(1, 1, i, T0 + dt.timedelta(minutes=i * 7 // 2), rng.choice([0.0, 33.33, 66.67, 100.0, rng.randint(0, 10000) / 100])) for i in range(1500)]
    rows += [(u, s, 5000 + i, T0 + dt.timedelta(hours=rng.randint(0, 90)), rng.randint(0, 100) * 1.0) for u in range(2, 40) for s in (1, 2) for i in range(rng.randint(1, 30))]
    rows += [(9, None, 1, T0, 5.0), (None, 3, 2, T0, 12.5), (None, 3, 3, T0, 50.0)]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "user_id long, subject_id long, attempt_id long, submitted_at timestamp, percentage double").repartition(3)
    wanted, state = [], {}
    for user, subject, attempt, at, pct in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[3], r[2])):
        n, mean = state.get((user, subject), (0, 0))
        n += 1
        mean = (2 * (mean * (n - 1) + round(pct * 100)) + n) // (2 * n)
        state[user, subject] = n, mean
        wanted.append((user, subject, n, mean / 100.0, at))
    got = [tuple(r) for r in ln.subject_progress_history(df).collect()]
    key = lambda r: (r[0] or 0, r[1], r[2])
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_reviews_of_hot_cards(spark, small_segments):
    """Cards that always lapse, never do, sit at one day for ever, grow to the longest interval, and mixed ones."""
    rng = random.Random(3)
    cards = {1: [2] * 700, 2: [1] * 700, 3: [rng.choice([0, 1, 2, 3]) for _ in range(1200)], 4: [0] * 300, 5: [1] * 260 + [3] * 400, 6: ([2] * 90 + [0]) * 6,
             7: [rng.choice([1, 1, 1, 2]) for _ in range(500)], **{c: [rng.randint(0, 3) for _ in range(rng.randint(1, 25))] for c in range(10, 60)}}
    rows = [(c * 10_000 + i, 1 + c % 2, c, r, T0 + dt.timedelta(minutes=i)) for c, ratings in cards.items() for i, r in enumerate(ratings)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "id long, user_id long, flashcard_id long, rating int, reviewed_at timestamp").repartition(3)
    got = {r.review_id: r for r in rv.review_schedule(df).drop("next_review_at").collect()}
    assert len(got) == len(rows)
    state = {}
    for rid, user, card, rating, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        old = state.get(card, rv.NEW_CARD)
        new = state[card] = rv.review_step(old, rating)
        r = got[rid]
        assert (r.user_id, r.flashcard_id, r.previous_interval, r.next_interval, r.previous_ease, r.next_ease, r.repetitions, r.lapse_count) == (
            user, card, old[1], new[1], old[2] / 100.0, new[2] / 100.0, new[0], new[3])
    assert max(r.next_interval for r in got.values()) == rv.LONGEST


def test_a_hot_key_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(nb, "SEGMENT", 100)
    df = spark.createDataFrame([(1, 1, i, T0 + dt.timedelta(minutes=i), 50.0) for i in range(2000)], "user_id long, subject_id long, attempt_id long, submitted_at timestamp, percentage double")
    keys = ["user_id", "subject_id"]
    rows = nb.segments(df, keys, [F.to_date("submitted_at")], [F.asc("submitted_at"), F.asc("attempt_id")])
    spread = rows.repartition(8, *keys, "_segment").select(F.spark_partition_id().alias("p"), "_segment").distinct().groupBy("p").count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) <= 12
