"""Text scans, upload register, embeddings and nested payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Fixed values of the upload rules.
EXTENSIONS = ("pdf", "docx", "txt", "md")
MAX_BYTES = 30 * 1024 * 1024


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole .txt and .md files as (path, content); bytes that are no UTF-8 are dropped."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,TXT,MD}")
           .option("recursiveFileLookup", "true").load(path))
    text = F.col("content").cast("string")
    broken = F.when(~F.is_valid_utf8(text), F.col("content"))  # only such files go to Python
    return raw.select("path", F.coalesce(decode_lossy(broken), text).alias("content"))


@F.pandas_udf(T.StringType())
def decode_lossy(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that do not decode; JVM decoding would put a replacement character instead."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))


def register_files(files: DataFrame) -> DataFrame:
    """(path, content, length) to the upload register; ``reason`` says why a file is refused.

    Only accepted files are read and hashed.  The stored name is made of the upload's path and its checksum, so two
    uploads of the same bytes and name are stored apart.
    """
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    stem = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
    reason = (F.when(~ext.isin(*EXTENSIONS), F.concat(F.lit("unsupported file type: "), ext))
              .when(F.col("length") > MAX_BYTES, "file exceeds 30 MB"))
    sha = F.when(reason.isNull(), F.sha2("content", 256))
    place = F.substring(F.sha2(F.concat("path", F.lit(":"), sha).cast("binary"), 256), 1, 32)
    return files.select("path", name.alias("original_name"), ext.alias("file_extension"), F.col("length").alias("file_size_bytes"),
                        sha.alias("checksum_sha256"), F.concat(place, F.lit("_"), stem).alias("stored_name"),
                        reason.alias("reason"), F.when(reason.isNull(), "UPLOADED").alias("status"))


def load_embeddings(rows: DataFrame) -> DataFrame:
    """(chunk_id, embedding_model, embedding_json) to float vectors with their dimension."""
    vector = F.from_json("embedding_json", "array<float>")
    return rows.select("chunk_id", "embedding_model", F.size(vector).alias("embedding_dimension"), vector.alias("embedding"))


def embeddings_to_json(rows: DataFrame) -> DataFrame:
    """S4, the other way."""
    return rows.withColumn("embedding_json", F.to_json("embedding")).drop("embedding")


QUIZ_PAYLOAD = ("payload_id long, title string, document_ids array<long>, questions array<struct<question_text:string,"
                "difficulty:string,explanation:string,points:decimal(8,2),source_chunk_id:long,options:array<struct<"
                "option_key:string,option_text:string,is_correct:boolean,position:int>>>>")
DECK_PAYLOAD = ("payload_id long, title string, document_ids array<long>, cards array<struct<front_text:string,"
                "back_text:string,hint:string,source_chunk_id:long>>")


def normalize_quizzes(nested: DataFrame) -> dict[str, DataFrame]:
    """Quiz payloads to questions (numbered from 1), options and document links; ids are parent id + position."""
    q = nested.select("payload_id", F.posexplode("questions").alias("_i", "_q"))
    key = F.concat_ws(":", "payload_id", F.col("_i") + 1)
    questions = q.select("payload_id", key.alias("question_key"), (F.col("_i") + 1).alias("question_order"),
                         "_q.question_text", "_q.difficulty", "_q.explanation", "_q.points", "_q.source_chunk_id")
    options = q.select(key.alias("question_key"), F.explode("_q.options").alias("_o")).select("question_key", "_o.*")
    return {"questions": questions, "options": options, "documents": _links(nested)}


def normalize_decks(nested: DataFrame) -> dict[str, DataFrame]:
    """Deck payloads to cards (numbered from 1) and document links."""
    cards = nested.select("payload_id", F.posexplode("cards").alias("_i", "_c")).select(
        "payload_id", (F.col("_i") + 1).alias("card_order"), "_c.*")
    return {"cards": cards, "documents": _links(nested)}


def _links(nested: DataFrame) -> DataFrame:
    return nested.select("payload_id", F.explode(F.array_distinct("document_ids")).alias("document_id"))
