"""Versioned chunk sets and text listings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def publish_chunk_set(staged: DataFrame, current: DataFrame, at: Column, issues: DataFrame | None = None) -> DataFrame:
    """Rows after the switch: the staged set of a document active, its older rows superseded at ``at``.

    Documents without a staged set keep their state, and so do those with a row in ``issues`` (``chunk_set_issues`` of the
    staged rows): a set that fails its checks never goes live.
    """
    if issues is not None:
        staged = staged.join(issues.select("document_id").distinct(), "document_id", "left_anti").select(staged.columns)
    switched = staged.select("document_id").distinct().withColumn("_new", F.lit(True))
    old = current.join(switched, "document_id", "left")
    replaced = F.coalesce("_new", F.lit(False)) & F.col("is_active")
    old = old.withColumns({"superseded_at": F.when(replaced, at).otherwise(F.col("superseded_at")),
                           "is_active": F.col("is_active") & F.col("_new").isNull()}).drop("_new")
    new = staged.withColumns({"is_active": F.lit(True), "superseded_at": F.lit(None).cast(current.schema["superseded_at"].dataType)})
    return old.unionByName(new)


def write_chunk_version(rows: DataFrame, root: str, version: int) -> None:
    """S5 on storage: write a complete new version into a folder of this attempt, then switch by appending number and
    folder to the pointer table.

    A reader sees the old version until the one-row pointer file is committed.  A failed write leaves a folder that
    nothing points to, and the same number may be written again.
    """
    folder = f"version={version}-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").partitionBy("is_active").parquet(f"{root}/{folder}")
    spark = rows.sparkSession
    spark.range(1).select(F.lit(version).alias("version"), F.lit(folder).alias("folder")).coalesce(1).write.mode("append").parquet(f"{root}/_pointer")


def read_chunk_version(spark: SparkSession, root: str) -> DataFrame:
    last = spark.read.schema("version int, folder string").parquet(f"{root}/_pointer").agg(F.max(F.struct("version", "folder")).alias("p")).first()["p"]
    rows = spark.read.parquet(f"{root}/{last['folder']}")
    return rows.withColumn("is_active", F.col("is_active").cast("boolean"))  # a folder name gives its value as text


# Wording of the listings.
QUESTION_LINE, EXPLANATION_LINE, MINUTES = "Câu %d: %s", "  Giải thích: %s", "phút"


def quiz_lines(questions: DataFrame, options: DataFrame) -> DataFrame:
    """Lines of each quiz: question, options with " *" on the right one, explanation, blank line."""
    option = F.concat(F.lit("  "), "option_key", F.lit(". "), "option_text", F.when(F.col("is_correct"), " *").otherwise(""))
    opts = options.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", option.alias("t")))),
                                                          lambda x: x.t).alias("_o"))
    q = questions.withColumnRenamed("id", "question_id").join(opts, "question_id", "left")
    none = F.array().cast("array<string>")
    block = F.concat(
        F.array(F.format_string(QUESTION_LINE, "question_order", "question_text")), F.coalesce("_o", none),
        F.when(F.coalesce("explanation", F.lit("")) != "", F.array(F.format_string(EXPLANATION_LINE, "explanation"))).otherwise(none),
        F.array(F.lit("")))
    return q.select(F.lit("QUIZ").alias("resource_type"), F.col("quiz_id").alias("resource_id"), "question_order",
                    F.posexplode(block).alias("part_no", "line"))


def deck_lines(cards: DataFrame) -> DataFrame:
    """One entry per card, front and back on two lines."""
    return cards.select(F.lit("FLASHCARD_DECK").alias("resource_type"), F.col("deck_id").alias("resource_id"),
                        "card_order", F.format_string("%d. %s\n   → %s", "card_order", "front_text", "back_text").alias("line"))


def plan_lines(tasks: DataFrame) -> DataFrame:
    """One line per task."""
    line = F.concat(F.col("task_date").cast("string"), F.lit(": ["), "task_type", F.lit("] "), "title", F.lit(" ("),
                    F.col("estimated_minutes").cast("string"), F.lit(f" {MINUTES})"))
    return tasks.select(F.lit("STUDY_PLAN").alias("resource_type"), F.col("plan_id").alias("resource_id"), "task_date",
                        "sort_order", line.alias("line"))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Write a listing as text, one folder per resource, lines in order inside a file."""
    (lines.repartition("resource_id").sortWithinPartitions("resource_id", *order)
     .select("resource_id", "line").write.mode("errorifexists").partitionBy("resource_id").text(path))
