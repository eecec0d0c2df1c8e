"""Card review scheduling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from studyloom.operators.numbering import fold_segments, fresh, full_segments, packed_map, segment_starts, segments, started
from studyloom.session import cut

# Fixed values of the review rule; ease in hundredths.
START_EASE, LOW_EASE, HIGH_EASE = 250, 130, 350
EASE_CHANGE = {0: -20, 1: -15, 2: 0, 3: 15}

# Longest interval in days; a date further on cannot be written down.
LONGEST = 100_000_000

NEW_CARD = (0, 0, START_EASE, 0)  # repetitions, interval, ease, lapses


def review_step(state: tuple[int, int, int, int], rating: int) -> tuple[int, int, int, int]:
    """One review.  The interval uses the ease before the review; Python rounds half to even."""
    reps, interval, ease, lapses = state
    factor, base = ease / 100.0, max(1, interval)
    reps = 0 if rating == 0 else reps + 1
    if rating == 0:
        interval, lapses = 1, lapses + 1
    elif rating == 1:
        interval = max(1, round(base * 1.2))
    elif rating == 2:
        interval = {1: 1, 2: 3}.get(reps) or max(1, round(base * factor))
    else:
        interval = 4 if reps == 1 else max(2, round(base * factor * 1.3))
    ease = min(HIGH_EASE, max(LOW_EASE, ease + EASE_CHANGE[rating]))
    return reps, min(interval, LONGEST), ease, lapses


KEYS = ["user_id", "flashcard_id"]
# Intervals from here on grow beyond any limit within a segment without a lapse, whatever the ratings that let them grow.
GROWS = 64


def review_steps(state: list[np.ndarray], rating: np.ndarray) -> list[np.ndarray]:
    """U1 for many cards at once."""
    reps, interval, ease, lapses = state
    lapse, base, factor = rating == 0, np.maximum(1, interval), ease / 100.0
    reps = np.where(lapse, 0, reps + 1)
    good = np.where(reps == 1, 1, np.where(reps == 2, 3, np.maximum(1, np.rint(base * factor))))
    easy = np.where(reps == 1, 4, np.maximum(2, np.rint(base * factor * 1.3)))
    new = np.where(lapse, 1, np.where(rating == 1, np.maximum(1, np.rint(base * 1.2)), np.where(rating == 2, good, easy)))
    change = np.array([EASE_CHANGE[i] for i in range(4)])
    return [reps, np.minimum(new, LONGEST).astype(np.int64), np.clip(ease + change[rating], LOW_EASE, HIGH_EASE), lapses + lapse]


def _map_of(table: pa.Table, states: list[np.ndarray], kept: int) -> pa.Table:
    """What a segment makes of each state."""
    table = table.sort_by("_n")
    for rating in table["rating"].to_numpy():
        states = review_steps(states, np.full(len(states[0]), rating))
    return pa.table({**{k: table[k].slice(0, 1) for k in (*KEYS, "_segment")}, "_map": pa.array([packed_map(states[kept])], pa.binary())})


def _ease_map(table: pa.Table) -> pa.Table:
    ease = np.arange(LOW_EASE, HIGH_EASE + 1)
    return _map_of(table, [np.zeros_like(ease), np.zeros_like(ease), ease, np.zeros_like(ease)], 2)


def _interval_map(table: pa.Table) -> pa.Table:
    interval = np.arange(GROWS + 1)
    first = table.slice(0, 1)
    return _map_of(table, [np.full(GROWS + 1, first["_reps"][0].as_py()), interval, np.full(GROWS + 1, first["_ease"][0].as_py()), np.zeros_like(interval)], 1)


def _starts(rows: DataFrame, full: DataFrame) -> DataFrame:
    """State at the start of every segment.  Ease is a chain of clamped additions and takes 221 values; repetitions count from the last lapse;
    with both known a segment's effect on the interval is a map, too: a lapse in it restarts the interval, and without one an interval
    of GROWS days or more ends at the longest."""
    segment = [rows.schema[k] for k in (*KEYS, "_segment")]
    kind = T.StructType([*segment, T.StructField("_map", T.BinaryType())])
    eases = full.groupBy(*KEYS, "_segment").applyInArrow(_ease_map, kind)
    eases = segment_starts(eases, KEYS, lambda ease: ease - LOW_EASE, START_EASE).withColumnRenamed("_start", "_ease")
    before = W.partitionBy(*KEYS).orderBy("_segment").rowsBetween(W.unboundedPreceding, 0)
    sums = full.groupBy(*KEYS, "_segment").agg(F.count_if(F.col("rating") == 0).alias("lapses"), F.max(F.when(F.col("rating") == 0, F.col("_n"))).alias("lapse"), F.max("_n").alias("n"))
    sums = sums.select(*KEYS, (F.col("_segment") + 1).alias("_segment"), F.sum("lapses").over(before).alias("_lapses"), (F.col("n") - F.coalesce(F.max("lapse").over(before), F.lit(0))).alias("_reps"))
    known = cut(eases.join(sums, [*KEYS, "_segment"]))
    intervals = started(full, known, KEYS, _ease=START_EASE, _reps=0).groupBy(*KEYS, "_segment").applyInArrow(_interval_map, kind)
    intervals = segment_starts(intervals, KEYS, lambda interval: np.minimum(interval, GROWS), 0).withColumnRenamed("_start", "_interval")
    return fresh(known).join(intervals, [*KEYS, "_segment"])


def review_schedule(reviews: DataFrame) -> DataFrame:
    """Review history per (user, card) with interval and ease before and after each review; intervals end at LONGEST days.

    Each step needs the rounded result of the one before it.  The reviews of a card are cut into segments, whose starts follow
    from maps composed in a tree; all segments are then stepped through side by side.
    """
    rows = reviews.select(*KEYS, "reviewed_at", "id", "rating")
    rows = cut(segments(rows, KEYS, [F.coalesce(F.to_date("reviewed_at"), F.lit("0001-01-01").cast("date"))], [F.asc("reviewed_at"), F.asc("id")]))
    full, new = full_segments(rows, KEYS), {"_reps": 0, "_interval": 0, "_ease": START_EASE, "_lapses": 0}
    if full.limit(1).count():
        rows = started(rows, _starts(rows, full), KEYS, **new)
    else:
        rows = rows.withColumns({c: F.lit(v).cast("long") for c, v in new.items()})

    def begin(batch: pa.RecordBatch, first: np.ndarray) -> list[np.ndarray]:
        return [batch.column(c).to_numpy()[first].copy() for c in new]

    def step(state: list[np.ndarray], batch: pa.RecordBatch, at: np.ndarray) -> list[np.ndarray]:
        return review_steps(state, batch.column("rating").to_numpy()[at])

    def emit(batch: pa.RecordBatch, before: list[np.ndarray], after: list[np.ndarray]) -> pa.RecordBatch:
        computed = [before[1], after[1], before[2] / 100.0, after[2] / 100.0, after[0], after[3]]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", *KEYS, "rating")], *[pa.array(x) for x in computed], batch.column("reviewed_at")], [f.name for f in fields])

    kinds = [("previous_interval", T.LongType()), ("next_interval", T.LongType()), ("previous_ease", T.DoubleType()), ("next_ease", T.DoubleType()), ("repetitions", T.LongType()), ("lapse_count", T.LongType())]
    fields = [T.StructField("review_id", rows.schema["id"].dataType), *[rows.schema[c] for c in (*KEYS, "rating")], *[T.StructField(n, k) for n, k in kinds], rows.schema["reviewed_at"]]
    done = fold_segments(rows, KEYS, begin, step, emit, T.StructType(fields))
    return done.withColumn("next_review_at", F.expr("reviewed_at + make_dt_interval(cast(next_interval as int), 0, 0, 0)"))


def review_progress(history: DataFrame) -> DataFrame:
    """State of each (user, card) after its last review."""
    last = F.max_by(F.struct("repetitions", F.col("next_interval").alias("interval_days"), F.col("next_ease").alias("ease_factor"),
                             "lapse_count", F.col("rating").alias("last_rating"), "next_review_at"),
                    F.struct("reviewed_at", "review_id"))
    return history.groupBy("user_id", "flashcard_id").agg(last.alias("_s")).select("user_id", "flashcard_id", "_s.*")
