"""Licence scan: a trained paragraph classifier, all in DataFrame functions.

Paragraphs are lines, read in windows of some words, so a notice inside a long line is seen as one on a line of its own.  Features are hashed
words and word pairs.  One logistic regression for each licence family is trained by proximal gradient steps on a bounded sample: windows
of the families' notices, windows that name a family, and others; soft thresholds keep the weights sparse.

The largest weights of a window's features, over all families, bound what any family can give it: only lines with a window whose bound is high
enough, or that speak of licences in general words, leave the scan.  Each distinct window is scored once.  A family needs the probability
that held-out rows call for; below it a line that speaks of licences is ``unknown``.  A notice whose word triples are in a window to a good
part confirms the family.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.common import cut, stored
from studyloom.operators.numbering import unfold

UNKNOWN = "unknown"
# Documents whose paragraphs are trained on, about, chosen by a hash of the text.
SAMPLE_DOCS = 1500
ROUNDS, RATE, SPARSE = 12, 3.0, 0.0005
# Words of a window, and from one window to the next.
WINDOW, STRIDE = 16, 8
# Entries of the table of largest weights; features that share an entry share the larger weight.
ENTRIES = 1 << 16
# Tasks that the small training tables are dealt to.
TRAINERS = 4
# Share of a notice's word triples that must be in a window to confirm its family.
CONFIRM = 0.5
GENERAL = r"\b(licen[cs]ed? |licen[cs]e\b|copyright\b|all rights\b)"

# Licence families, a pattern over lowered words that names each, and texts of its usual notices.
FAMILIES = {
    "apache": (r"\bapache licen[cs]e\b", [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."]),
    "bsd": (r"\bbsd\b.{0,12}\blicen[cs]e\b", [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]),
    "cc-by": (r"\b(cc by|creative commons attribution)\b(?! (nc|sa|nd|noncommercial|sharealike))", [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"]),
    "cc-by-nc": (r"\b(cc by nc|creative commons attribution noncommercial)\b", [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"]),
    "cc-by-sa": (r"\b(cc by sa|creative commons attribution sharealike)\b", [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"]),
    "gpl": (r"\bgnu general public licen[cs]e\b", [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."]),
    "lgpl": (r"\bgnu lesser general public licen[cs]e\b", [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."]),
    "mit": (r"\bmit licen[cs]e\b", [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]),
    "mpl": (r"\bmozilla public licen[cs]e\b", [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."]),
    "reserved": (r"\ball rights reserved\b", [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced, stored or transmitted in any form or by any means without the prior written permission of the publisher."]),
}


def words_of(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def features_of(words: F.Column) -> F.Column:
    """Distinct hashes of words and word pairs; the last word is paired with nothing."""
    return F.array_distinct(_hashes(words))


def _hashes(words: F.Column) -> F.Column:
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit("")))))


def triples_of(words: F.Column) -> F.Column:
    """Distinct word triples; the whole sequence where there are fewer words."""
    n = F.size(words)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " ")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph number from 0, text) of the lines that hold a letter; null texts have none."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "text"))
    return lines.where(F.col("text").rlike(r"\p{L}"))


def windows(words: F.Column) -> F.Column:
    """Windows of WINDOW words, one every STRIDE words; the last one has over half of a window, where there is more than one."""
    last = F.greatest(F.ceil((F.size(words) - WINDOW) / STRIDE), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * STRIDE + 1, WINDOW))


def templates(spark: SparkSession) -> DataFrame:
    """(family, words): windows of the notices."""
    rows = spark.createDataFrame([(family, text) for family, (_, texts) in FAMILIES.items() for text in texts], "family string, text string")
    split = rows.select("family", F.explode(F.array(words_of(F.col("text")))).alias("all"))
    return unfold(split, ["family"], windows(F.col("all")), "_i", "words").drop("_i")


def named_family(words: F.Column) -> F.Column:
    """Family whose pattern fits a window first, null where none does."""
    text = F.array_join(words, " ")
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(family)) for family, (pattern, _) in FAMILIES.items()])


def training_rows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(row, family, held, features) of distinct windows: those of the notices, and those of a sample of documents, named by the first
    pattern that fits; family is null where none does.  About ``sample_docs`` documents are read; notices are never held out."""
    spark, span = docs.sparkSession, 1 << 30
    share = int(span * min(1.0, sample_docs / max(1, docs.count())))
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(span)) <= share).select("doc_id", "text")
    split = unfold(paragraphs(picked), [], F.array(words_of(F.col("text"))), "_i", "all").select("all").distinct()
    read = unfold(split, [], windows(F.col("all")), "_i", "words").select("words").distinct()
    mark = F.xxhash64(F.array_join("words", " "))
    found = read.select(named_family(F.col("words")).alias("family"), "words", (F.pmod(mark, F.lit(5)) == 0).alias("held"))
    # One in eight of the many windows that name no family is enough.
    found = found.where(F.col("family").isNotNull() | (F.pmod(F.xxhash64(F.array_join("words", " "), F.lit(1)), F.lit(8)) == 0))
    rows = templates(spark).select("family", "words", F.lit(False).alias("held")).union(found)
    return rows.select(F.monotonically_increasing_id().alias("row"), "family", "held", features_of(F.col("words")).alias("features"))


def margins(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(row, family, margin): sum of the weights of a row's features, scaled by the root of their number."""
    flat = rows.select("row", F.explode("features").alias("feature"), (1 / F.sqrt(F.size("features"))).alias("value"))
    return flat.join(weights, "feature").groupBy("row", "family").agg(F.sum(F.col("value") * F.col("weight")).alias("margin"))


def train(rows: DataFrame, rounds: int = ROUNDS, rate: float = RATE, sparse: float = SPARSE) -> DataFrame:
    """(feature, family, weight) after proximal gradient steps; the intercept is feature 0, on in every row.  Rows of a family weigh as much
    as all the others together."""
    learn = rows.where("not held").withColumn("features", F.concat(F.array(F.lit(0).cast("long")), "features"))
    target = learn.select("row", "family", F.explode(F.array(*map(F.lit, FAMILIES))).alias("of"))  # every row answers every family
    target = target.select("row", F.col("of").alias("family"), F.coalesce(F.col("family") == F.col("of"), F.lit(False)).cast("double").alias("y"))
    totals = target.groupBy("family").agg(F.sum("y").alias("inside"), F.sum(1 - F.col("y")).alias("outside"))
    target = cut(target.join(totals, "family").select("row", "family", "y", F.when(F.col("y") == 1, 0.5 / F.col("inside")).otherwise(0.5 / F.greatest("outside", F.lit(1.0))).alias("share")))
    flat = cut(learn.select("row", F.explode("features").alias("feature"), (1 / F.sqrt(F.size("features"))).alias("value")))
    weights = flat.sparkSession.createDataFrame([], "feature long, family string, weight double")
    for _ in range(rounds):
        sums = flat.join(weights, "feature").groupBy("row", "family").agg(F.sum(F.col("value") * F.col("weight")).alias("margin"))
        wrong = target.join(sums, ["row", "family"], "left").select("row", "family", (F.col("share") * (F.col("y") - 1 / (1 + F.exp(-F.coalesce("margin", F.lit(0.0)))))).alias("wrong"))
        slope = flat.join(wrong, "row").groupBy("feature", "family").agg(F.sum(F.col("value") * F.col("wrong")).alias("slope"))
        moved = slope.join(weights, ["feature", "family"], "left").select("feature", "family", (F.coalesce("weight", F.lit(0.0)) + rate * 10 * F.col("slope")).alias("w"))
        pull = F.when(F.col("feature") == 0, 0.0).otherwise(rate * 10 * sparse)
        soft = F.signum("w") * F.greatest(F.abs("w") - pull, F.lit(0.0))
        weights = cut(moved.select("feature", "family", soft.alias("weight")).where("weight <> 0").coalesce(TRAINERS))
    return weights


def probability(margin: F.Column) -> F.Column:
    return 1 / (1 + F.exp(-margin))


def best_family(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(row, family, probability): the likeliest family of every row with a feature; ties go to the first by name."""
    scored = margins(rows.withColumn("features", F.concat(F.array(F.lit(0).cast("long")), "features")), weights)
    best = scored.groupBy("row").agg(F.max(F.struct("margin", F.col("family"))).alias("best"))
    return best.select("row", F.col("best.family").alias("family"), probability(F.col("best.margin")).alias("probability"))


def needed_probability(rows: DataFrame, weights: DataFrame) -> float:
    """Least probability that makes a family: half way between what held-out rows of families and other held-out rows get at their
    outer hundredth; a half without held-out rows of either kind."""
    judged = best_family(rows.where("held"), weights).join(rows.where("held").select("row", F.col("family").alias("truth")), "row")
    q = judged.agg(F.percentile_approx(F.when(F.col("truth") == F.col("family"), F.col("probability")), 0.01, 10000).alias("low"),
                   F.percentile_approx(F.when(F.col("truth").isNull(), F.col("probability")), 0.99, 10000).alias("high")).first()
    if q["low"] is None or q["high"] is None or q["low"] <= q["high"]:
        return 0.5
    return (q["low"] + q["high"]) / 2


def largest_weights(weights: DataFrame) -> F.Column:
    """Array of the largest weight, 0 at least, of the features of every entry; the features are those of a bounded sample."""
    best = weights.where("feature <> 0 and weight > 0").groupBy(F.pmod("feature", F.lit(ENTRIES)).alias("entry")).agg(F.max("weight").alias("weight")).toPandas()
    table = np.zeros(ENTRIES)
    table[best["entry"].to_numpy("i8")] = best["weight"].to_numpy("f8")
    shown = ",".join("0" if x == 0 else f"{math.ceil(x * 1000) / 1000:g}" for x in table)  # never less than the weight
    return F.split(F.lit(shown), ",").cast("array<float>")


def least_sum(weights: DataFrame, needed: float) -> float:
    """Sum of weights that a window needs to reach the probability in any family.

    With intercept b and n features a margin is (b + sum) over the root of n + 1, and n is from 1 to 2 WINDOW.
    """
    margin = math.log(max(needed, 1e-9) / max(1 - needed, 1e-9))
    intercept = weights.where("feature = 0").agg(F.max("weight")).first()[0] or 0.0
    return margin * math.sqrt(2 if margin > 0 else 2 * WINDOW + 1) - max(intercept, 0.0 if weights.where("feature = 0").count() < len(FAMILIES) else intercept)


def can_reach(words: F.Column, largest: F.Column, least: float) -> F.Column:
    """Has a line a window whose largest weights add up to ``least``?  A word counts with the pair it begins, or as a window's last word."""
    of = lambda *x: F.get(largest, F.pmod(F.xxhash64(*x), F.lit(ENTRIES)).cast("int"))
    bound = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: of(a) + F.greatest(of(a, F.coalesce(b, F.lit(""))), of(a, F.lit(""))))
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    # The bounds are made once for all windows.
    return F.exists(F.array(bound), lambda each: F.exists(windows(each), lambda part: total(part) >= least - 1e-6))


def scan(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of every paragraph that is, holds or looks like a licence notice.

    A paragraph is judged by its best window: one of a family before one of none, confirmed before unconfirmed, then by probability.
    ``family`` is ``unknown`` where no family reaches the calibrated probability but the paragraph speaks of licences in general words.
    Null, empty and letterless texts have no such paragraphs; lines of any length are read in windows; repeated rows give their paragraphs
    each; ties go to the last family by name; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    rows = cut(training_rows(docs, sample_docs))
    weights = cut(train(rows))
    needed = needed_probability(rows, weights)
    largest, least = largest_weights(weights), least_sum(weights, needed)
    general = F.lower("text").rlike(GENERAL)
    lines = paragraphs(docs.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc_id"), "text"))
    # The words are bound once for the test and for the result.
    split = F.filter(F.array(words_of(F.col("text"))), lambda words: general | can_reach(words, largest, least))
    held = stored(unfold(lines, ["doc_id", "paragraph", general.alias("general")], split, "_i", "words").drop("_i"))
    each = unfold(held, ["doc_id", "paragraph", "general"], windows(F.col("words")), "_i", "words").drop("_i")
    each = each.where(F.col("general") | can_reach(F.col("words"), largest, least))
    each = stored(each.withColumn("key", F.unhex(F.md5(F.array_join("words", " ").cast("binary")))))
    texts = stored(each.groupBy("key").agg(F.min("words").alias("words")))
    texts = stored(texts.select(F.col("key").alias("row"), features_of(F.col("words")).alias("features"), triples_of(F.col("words")).alias("triples")))
    judged = best_family(texts.select("row", "features"), weights)
    named = templates(docs.sparkSession).select("family", triples_of(F.col("words")).alias("of"))
    likely = texts.join(judged, "row").withColumn("family", F.when(F.col("probability") >= needed, F.col("family")).otherwise(F.lit(UNKNOWN)))
    alike = F.size(F.array_intersect("triples", "of")) / F.size("of")
    compared = likely.join(F.broadcast(named), "family", "left").groupBy("row", "family", "probability").agg(F.coalesce(F.max(alike), F.lit(0.0)).alias("similarity"))
    met = each.drop("words").join(compared.withColumnRenamed("row", "key"), "key").where((F.col("family") != UNKNOWN) | F.col("general"))
    rank = F.struct((F.col("family") != UNKNOWN).alias("known"), (F.col("similarity") >= confirm).alias("confirmed"), "probability", "similarity", "family")
    best = met.groupBy("doc_id", "paragraph").agg(F.max(rank).alias("best"))
    return best.select("doc_id.doc_id", "paragraph", "best.family", "best.probability", "best.similarity", "best.confirmed")
