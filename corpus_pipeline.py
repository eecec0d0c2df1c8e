"""Corpus pipeline: language ID, quality, near-duplicates, benchmark decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads it back as the
next stage's ``docs``.  All stages but the last return the columns of their input.  Whole rows travel through the operators as their id, so
extra columns, whatever their names, arrive untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import kneser_ney, overlap, ppm, simhash, suffix_automaton, word_bpe
from studyloom.llm.common import stored
from studyloom.llm.queries import digests, learning_texts, trusted_texts
from studyloom.session import tune


def _whole(docs: DataFrame, *others: str) -> DataFrame:
    """The rows as structs under the name doc_id, with the columns that an operator reads beside them."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc_id"), *others)


def _rows(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col("doc_id").getField(c).alias(c) for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter go.  ``lang`` becomes the predicted language, also where it was null."""
    found = ppm.identify(_whole(docs, "text"), learning_texts(docs)).where(F.col("lang_pred") != ppm.UNKNOWN)
    named = found.select(F.col("doc_id").withField("lang", F.col("lang_pred")).alias("doc_id"))
    return _rows(named, docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the perplexity threshold of their language, learnt from the trusted documents among them."""
    trusted = trusted_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _rows(kneser_ney.judge(_whole(docs, "lang", "text"), trusted).where("keep"), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles of Jaccard similarity 0.8 or more.

    SimHash blocks find candidates within 4 bits and the shingle sets verify them.  Near copies at 0.80 to 0.85 differ in 8 bits on average and
    up to 17, so min-hash bands bring further candidates to the same check.
    """
    return simhash.keep_one(docs, overlap.near_duplicates)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with benchmark items; those that are mostly such passages go."""
    return suffix_automaton.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of every document's token ids, and digest of what they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return digests(word_bpe.decode(word_bpe.encode(docs, path), path))


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]

# Trained models and BPE are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return stored(STAGES[-1][1](spark, docs, sf_dir))
