"""Keyed state as streams (T1-T5).  Given the same rows they end in the batch results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from studyloom.operators.chunking import chunk_documents
from studyloom.operators.learning import merge_aggregate
from studyloom.operators.reviews import NEW_CARD, review_step

PROGRESS = "user_id long, flashcard_id long, repetitions long, interval_days long, ease_factor double, lapse_count long"


def _review_rows(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of a key in a micro-batch may arrive in several Arrow batches, each out of time order."""
    card = tuple(state.get) if state.exists else NEW_CARD
    rows = pd.concat(list(batches)).sort_values(["reviewed_at", "id"])
    for rating in rows["rating"]:
        card = review_step(card, int(rating))
    state.update(card)
    yield pd.DataFrame([(*key, card[0], card[1], card[2] / 100.0, card[3])],
                       columns=[c.strip().split(" ")[0] for c in PROGRESS.split(",")])


def stream_reviews(reviews: DataFrame) -> DataFrame:
    """Progress per (user, card) after each micro-batch; reviews of a batch are applied in time order."""
    return reviews.groupBy("user_id", "flashcard_id").applyInPandasWithState(
        _review_rows, PROGRESS, "reps long, interval long, ease long, lapses long", "update", GroupStateTimeout.NoTimeout)


def stream_daily(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Sums per user and day.  ``events``: user_id, at, quiz_attempts, questions_answered, correct_answers,
    flashcards_reviewed, xp_earned; rows later than ``lateness`` are dropped."""
    sums = ["quiz_attempts", "questions_answered", "correct_answers", "flashcards_reviewed", "xp_earned"]
    return (events.withWatermark("at", lateness).groupBy(F.window("at", "1 day"), "user_id")
            .agg(*[F.sum(c).alias(c) for c in sums])
            .select("user_id", F.to_date("window.start").alias("activity_date"), *sums))


REWARDS = "user_id long, xp_total long, level_no long, current_streak long, longest_streak long, last_study_date date"


def _reward_rows(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    total, current, longest, last = state.get if state.exists else (0, 0, 0, None)
    rows = pd.concat(list(batches)).sort_values(["at", "id"])
    for amount, at in zip(rows["amount"], rows["at"]):
        day = at.date().toordinal()
        total = max(0, total + int(amount))
        if day != last:
            current = current + 1 if last is not None and day == last + 1 else 1
            longest, last = max(longest, current), day
    state.update((total, current, longest, last))
    level = max(1, int((total / 100) ** 0.5) + 1)
    yield pd.DataFrame([(*key, total, level, current, longest, pd.Timestamp.fromordinal(last).date())],
                       columns=[c.strip().split(" ")[0] for c in REWARDS.split(",")])


def stream_rewards(events: DataFrame) -> DataFrame:
    """XP, level and streak per user from (user_id, amount, at, id)."""
    return events.groupBy("user_id").applyInPandasWithState(
        _reward_rows, REWARDS, "total long, current long, longest long, last long", "update", GroupStateTimeout.NoTimeout)


def stream_mastery(answers: DataFrame) -> DataFrame:
    """T4: counts per (user, section) from (user_id, section_id, is_correct); the score follows from them."""
    return answers.filter("section_id is not null").groupBy("user_id", "section_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("is_correct").alias("correct_answers"),
        F.count_if(~F.col("is_correct")).alias("wrong_answers"))


def merge_into(path: str, keys: list[str], sums: list[str], count: Callable[[DataFrame], DataFrame] | None = None):
    """T4 + S6: a ``foreachBatch`` sink that adds what each micro-batch counts to a versioned table.

    ``count`` turns the batch's own rows into sums per key (``stream_mastery`` for raw answers); a running aggregate must not be fed
    here, it would be added again with every batch.  A batch writes the merged state under a name of its own, then a note that
    names it as version N and the version it builds on.  A repeated batch starts from the version before it, so it counts once; a
    stream that starts anew with batch 0 goes on after the last version of the stream before (``run`` tells streams apart).
    """
    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        rows = batch if count is None else count(batch)
        delta = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        notes = _notes(spark, path)
        mine = next((n for n in notes if (n["run"], n["batch"]) == (run, number)), None)
        base = mine["base"] if mine else max((n["version"] for n in notes), default=-1)
        if base >= 0:
            delta = merge_aggregate(spark.read.parquet(f"{path}/version={base}"), delta, keys, sums)
        version = mine["version"] if mine else base + 1
        delta.write.mode("overwrite").parquet(f"{path}/version={version}")
        note = spark.createDataFrame([(run, number, version, base)], NOTE)
        note.coalesce(1).write.mode("overwrite").parquet(f"{path}/_notes/version={version}")

    return sink


NOTE = "run string, batch long, number long, base long"


def _notes(spark: SparkSession, path: str) -> list[dict]:
    """One small note per version; a version without a note was never finished and does not count."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_notes")
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return []
    return [{"run": r["run"], "batch": r["batch"], "version": r["number"], "base": r["base"]}
            for r in spark.read.schema(NOTE).parquet(f"{path}/_notes/version=*").collect()]


def merged_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version written by ``merge_into``."""
    return spark.read.parquet(f"{path}/version={max(n['version'] for n in _notes(spark, path))}")


def stream_chunks(spark: SparkSession, path: str, sections: DataFrame, out: str, checkpoint: str, **options):
    """T5: chunk newly arrived parquet documents (document_id, content) and append them to ``out``."""
    docs = spark.readStream.schema("document_id long, content string").options(**options).parquet(path)
    return (docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda b, n: chunk_documents(b, sections).write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .start())
