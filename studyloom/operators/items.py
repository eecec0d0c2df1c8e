"""Raw question items to questions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from studyloom.functions.questions import (HIGH_RISK, KEYS, answer_candidates, candidate_score, correct_key, let,
                                           pick_distractors, relation, repair_high_risk, short_answer_issue,
                                           standalone_issue, strict_support)
from studyloom.functions.text import BULLET, collapse, front_key, norm_evidence, one_of, strip
from studyloom.operators.contexts import evidence_array
from studyloom.operators.numbering import numbered, top_per_key, unfold

# Fixed values.
LITERAL_MIN = 24
TRUE_WORDS = ("true", "1", "yes", "correct")


def answer_catalogue(spans: DataFrame, source: str = "source_ref", keep: int | None = None) -> DataFrame:
    """N13 + N33: answers A0.. of each source over its spans in order, with score and usability; all, or the first ``keep``.

    A source is one context, so the window per source is small.
    """
    rows = unfold(spans, [source, "evidence_id", "span_no", "span"], answer_candidates(F.col("span")), "_j", "answer")
    w = W.partitionBy(source).orderBy("span_no", "_j")
    kept = rows.withColumn("_n", F.row_number().over(w) - 1)
    kept = kept if keep is None else kept.filter(F.col("_n") < keep)
    usable = (standalone_issue(F.col("answer")).isNull() & short_answer_issue(F.col("answer"), F.col("span")).isNull()
              & strict_support(F.col("answer"), F.col("span")))
    return kept.select(source, F.concat(F.lit("A"), F.col("_n").cast("string")).alias("answer_id"), "evidence_id",
                       F.col("span").alias("evidence"), "answer",
                       candidate_score(F.col("answer"), F.col("span")).alias("score"), usable.alias("usable"))


def source_catalogue(contexts: DataFrame) -> DataFrame:
    """Contexts of a request distinct by (chunk, normalized text), S0.. by first slot.

    ``contexts``: request_id, slot, chunk_id, text.  Returns one row per slot with its ``source_ref``.
    """
    keyed = contexts.withColumn("_norm", norm_evidence(F.col("text")))
    first = keyed.groupBy("request_id", "chunk_id", "_norm").agg(F.min("slot").alias("_first"), F.min_by("text", "slot").alias("_text"))
    named = numbered(first, ["request_id"], [F.floor(F.col("_first") / 4096)], [F.asc("_first")], "source_no").withColumn(
        "source_no", F.col("source_no") - 1).select(
        "request_id", "chunk_id", "_norm", "_text", F.concat(F.lit("S"), F.col("source_no").cast("string")).alias("source_ref"))
    return keyed.drop("text").join(named, ["request_id", "chunk_id", "_norm"]).drop("_norm").withColumnRenamed("_text", "text")


def distractor_terms(chunks: DataFrame, per_chunk: int | None = None) -> DataFrame:
    """The distinct candidates of each section's chunks as rows (section_id, text, _at); ``_at`` is their order.

    ``chunks``: section_id, document_id, chunk_index, content.  All candidates of a chunk count, or its first
    ``per_chunk``.  Distinct texts are found by an aggregate, so no section is gathered as a whole.
    """
    spans = evidence_array(F.col("content"))
    spans = let(spans, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array("content")))
    found = F.flatten(F.transform(spans, answer_candidates))
    found = found if per_chunk is None else F.slice(found, 1, per_chunk)
    live = chunks.filter("section_id is not null").filter(strip(F.coalesce("content", F.lit(""))) != "")
    # Candidates are squeezed and have no punctuation at their ends: their lower case is what norm_compare makes of them.
    rows = unfold(live, ["section_id", "document_id", "chunk_index"], found, "_j", "text").withColumn("_norm", F.lower("text"))
    at = F.struct("document_id", "chunk_index", "_j")
    return rows.groupBy("section_id", "_norm").agg(F.min(at).alias("_at"), F.min_by("text", at).alias("text")).drop("_norm")


def distractor_pool(chunks: DataFrame, size: int, per_chunk: int | None = None) -> DataFrame:
    """N18 as one array per section for picking: its first ``size`` terms, which bounds the array; the rows are ``distractor_terms``."""
    kept = top_per_key(distractor_terms(chunks, per_chunk), ["section_id"], [F.asc("_at")], size, "_rn")
    return kept.groupBy("section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "text"))), lambda x: x.text).alias("pool"))


def _truth(value: Column) -> Column:
    return F.lower(strip(value)).isin(*TRUE_WORDS)


def normalize_items(raw: DataFrame, json_column: str = "item") -> DataFrame:
    """Raw question objects (JSON text) to stem, difficulty and four options A-D, or a reason.

    Options keep their array order; the right one follows its own flag, else the hint of the question.
    """
    shape = ("question_text string, question string, text string, difficulty string, correct_answer string,"
             " correct_option string, answer string, explanation string, options array<string>")
    one = ("option_key string, key string, label string, position string, option_text string, text string,"
           " content string, is_correct string, correct string")
    p = raw.withColumn("_q", F.from_json(json_column, shape))
    filled = lambda c: F.nullif(c, F.lit(""))
    hint = F.upper(strip(F.coalesce(filled(F.col("_q.correct_answer")), filled(F.col("_q.correct_option")), filled(F.col("_q.answer")))))
    p = p.withColumn("_hint", hint)

    def option(text, i):
        o = F.from_json(text, one)
        names = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
        own = F.coalesce(filled(o.option_key), filled(o.key), filled(o.label))
        at = F.upper(strip(o.position))
        key = F.upper(strip(F.coalesce(own, F.when(at.isin(*KEYS), at), F.element_at(one_of(KEYS), i + 1))))
        words_ = strip(F.coalesce(filled(o.option_text), filled(o.text), filled(o.content), F.lit("")))
        words_ = strip(F.regexp_replace(words_, r"\A" + BULLET, ""))
        right = (F.when(F.array_contains(names, "is_correct"), F.coalesce(_truth(o.is_correct), F.lit(False)))
                 .when(F.array_contains(names, "correct"), F.coalesce(_truth(o.correct), F.lit(False)))
                 .otherwise(F.coalesce(key == F.col("_hint"), F.lit(False))))
        return F.struct(key.alias("given_key"), words_.alias("option_text"), right.alias("is_correct"))

    p = p.withColumn("_o", F.transform("_q.options", option))
    reason = (F.when(F.col("_q").isNull() | F.col("_q.options").isNull(), "question options must be a list")
              .when(F.size("_o") != 4, "question must contain exactly 4 options")
              .when(F.exists("_o", lambda o: ~o.given_key.isin(*KEYS)), "invalid option key"))
    options = F.transform("_o", lambda o, i: F.struct(
        F.element_at(one_of(KEYS), i + 1).alias("option_key"), o.option_text.alias("option_text"),
        o.is_correct.alias("is_correct"), (i + 1).alias("position")))
    stem = F.coalesce(filled(F.col("_q.question_text")), filled(F.col("_q.question")), filled(F.col("_q.text")))
    keep = [c for c in raw.columns if c != json_column]
    return p.select(*keep, stem.alias("question_text"), F.upper(strip(F.col("_q.difficulty"))).alias("difficulty"),
                    reason.alias("reason"), F.when(reason.isNull(), options).alias("options"))


_DECODER = json.JSONDecoder()


def recover(text: str) -> list[str] | None:
    """N30 for one broken batch: each object of ``items`` that parses after dropping trailing commas."""
    text = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", (text or "").strip(), flags=re.I))
    opening = re.search(r'"items"\s*:\s*\[', text)
    if not opening:
        return None
    found, depth, start = [], 0, 0
    # Strings (closed or running to the end) are skipped as one token, so braces inside them do not count.
    for token in re.finditer(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}\]]', text[opening.end():], flags=re.S):
        mark = token.group()
        if mark == "{":
            start = token.start() if depth == 0 else start
            depth += 1
        elif mark == "}" and depth:
            depth -= 1
            if depth == 0:
                body = text[opening.end():][start:token.end()]
                try:
                    found.append(json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", body)), ensure_ascii=False))
                except json.JSONDecodeError:
                    pass
        elif mark == "]" and depth == 0:
            break
    return found or None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _recover_array(texts: pd.Series) -> pd.Series:
    return texts.map(recover)


def recover_items(batches: DataFrame, text_column: str = "content") -> DataFrame:
    """(batch columns, content) -> one row per item; only rows that do not parse go through Python."""
    stripped = F.regexp_replace(F.regexp_replace(strip(F.col(text_column)), r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", "")
    start = F.instr(stripped, "{")
    end = F.length(stripped) - F.instr(F.reverse(stripped), "}") + 1
    body = F.when(start > 0, F.substring(stripped, start, end - start + 1)).otherwise(stripped)
    keep = [c for c in batches.columns if c != text_column]
    # try_parse_json is null exactly for text that is no JSON; from_json alone would accept a cut-off batch.
    parsed = batches.withColumn("_valid", F.try_parse_json(body).isNotNull()).withColumn(
        "_items", F.from_json(body, "items array<string>").getField("items"))
    good = parsed.filter("_valid").select(*keep, F.posexplode("_items").alias("position", "item"))
    bad = unfold(parsed.filter("not _valid"), keep, _recover_array(text_column), "position", "item")
    return good.unionByName(bad)


ITEM = "slot string, slot_id string, id string, `index` string, q string, e string, a string, c string, d array<string>, o array<string>"


def resolve_slots(items: DataFrame, slots: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Items (request_id, position, item JSON) to the request's expected slots.

    Named slots by alias; a lone item named 0 goes to the lone expected slot; items without a name fill the
    remaining slots in order.  Unknown and repeated slots get a reason.  ``chosen`` (request_id, slot,
    answer_id, evidence_id) overrides what an item with distractors names.
    """
    p = items.withColumn("_i", F.from_json("item", ITEM))
    name = F.coalesce(*[F.nullif(strip(F.col(f"_i.{k}")), F.lit("")) for k in ("slot", "slot_id", "id", "index")])
    p = p.withColumn("_name", name)
    n_items = items.groupBy("request_id").agg(F.count(F.lit(1)).alias("_items"))
    n_slots = slots.groupBy("request_id").agg(F.count(F.lit(1)).alias("_slots"), F.min(F.col("slot").cast("string")).alias("_only"))
    p = p.join(n_items, "request_id").join(n_slots, "request_id", "left")
    lone = (F.col("_items") == 1) & (F.col("_slots") == 1) & (F.col("_name") == "0")
    p = p.withColumn("_name", F.when(lone, F.col("_only")).otherwise(F.col("_name")))
    expected = slots.select("request_id", F.col("slot").cast("string").alias("_name"), F.lit(True).alias("_known"))
    named = p.filter("_name is not null").join(expected, ["request_id", "_name"], "left")
    turn = F.row_number().over(W.partitionBy("request_id", "_name").orderBy("position"))
    named = named.withColumn("reason", F.when(F.col("_known").isNull(), "unexpected slot").when(turn > 1, "duplicate slot"))
    taken = named.filter("reason is null").select("request_id", F.col("_name").alias("slot"))
    by_position = W.partitionBy("request_id").orderBy("position")
    free = (slots.select("request_id", F.col("slot").cast("string").alias("slot"), F.col("slot").alias("_order"))
            .join(taken, ["request_id", "slot"], "left_anti")
            .withColumn("_k", F.row_number().over(W.partitionBy("request_id").orderBy("_order"))))
    loose = (p.filter("_name is null").withColumn("_k", F.row_number().over(by_position))
             .join(free.select("request_id", "_k", "slot"), ["request_id", "_k"], "left")
             .withColumn("reason", F.when(F.col("slot").isNull(), "more items without slot than free slots")))
    cols = ["request_id", "position", "slot", "reason", "_i"]
    out = named.withColumn("slot", F.col("_name")).select(cols).unionByName(loose.select(cols))
    if chosen is not None:
        pick = chosen.select("request_id", F.col("slot").cast("string").alias("slot"), F.col("answer_id").alias("_a"), F.col("evidence_id").alias("_e"))
        out = out.join(pick, ["request_id", "slot"], "left")
        fixed = F.col("_a").isNotNull() & F.col("_i.d").isNotNull()
        e, a = F.when(fixed, F.col("_e")).otherwise(F.col("_i.e")), F.when(fixed, F.col("_a")).otherwise(F.col("_i.a"))
    else:
        e, a = F.col("_i.e"), F.col("_i.a")
    return out.select("request_id", "position", "slot", "reason", F.col("_i.q").alias("q"), e.alias("e"), a.alias("a"),
                      F.col("_i.c").alias("c"), F.col("_i.d").alias("d"), F.col("_i.o").alias("o"))


RUNS = "array<struct<n:int,ids:string,text:string,norm:string>>"


def resolve_evidence(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The evidence an item names, as spans of its slot.

    By id; else one span with equal text; else the one shortest span that contains the literal (24 characters
    or more); else the one shortest run of consecutive spans.  Ambiguous or unknown evidence gets a reason.
    ``catalogue``: request_id, slot, span_no, evidence_id, span, any number of spans a slot.  Runs are tried
    shortest first, only where all spans together hold the literal, and up to the number of spans it can touch.
    """
    spans = catalogue.groupBy("request_id", F.col("slot").cast("string").alias("slot")).agg(F.array_sort(F.collect_list(
        F.struct("span_no", "evidence_id", "span"))).alias("_spans"))
    p = items.join(spans, ["request_id", "slot"], "left")
    answer = lambda ids, text, why: F.struct(
        F.lit(ids).cast("string").alias("ids") if ids is None else ids.alias("ids"),
        F.lit(text).cast("string").alias("text") if text is None else text.alias("text"), F.lit(why).cast("string").alias("why"))
    found = lambda e: answer(e.evidence_id, e.span, None)
    failed = lambda why: answer(None, None, why)

    def run(live, i, n):
        part = F.slice(live, i, n)
        text = F.array_join(F.transform(part, lambda e: e.span), " ")
        return F.struct(n.alias("n"), F.array_join(F.transform(part, lambda e: e.evidence_id), ",").alias("ids"),
                        text.alias("text"), norm_evidence(text).alias("norm"))

    def by_run(live, norm, long_enough):
        # A span of a run adds a character and a space at least; the two outer ones may reach beyond the literal.
        most = F.least(F.size(live), (F.length(norm) / 2).cast("int") + 3)
        held = F.contains(collapse(F.lower(F.array_join(F.transform(live, lambda e: e.span), " "))), strip(norm))
        of = lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.size(live) - n + 1), lambda i: run(live, i, n)),
                                lambda r: (r.norm == norm) | (long_enough & F.contains(r.norm, norm)))
        none = F.array().cast(RUNS)
        fit = F.when((F.size(live) > 0) & held, F.aggregate(F.sequence(F.lit(1), most), none, lambda met, n: F.when(
            F.size(met) > 0, met).otherwise(of(n)).cast(RUNS))).otherwise(none)
        size = lambda r: F.struct(r.n.alias("n"), F.length(r.norm).alias("len"))
        tied = let(fit, lambda f: let(F.array_min(F.transform(f, size)), lambda top: F.filter(f, lambda r: size(r) == top)))
        return let(tied, lambda x: F.when(F.size(x) == 1, answer(F.get(x, 0).ids, F.get(x, 0).text, None))
                   .when(F.size(x) > 1, failed("literal evidence maps to multiple runs of spans"))
                   .otherwise(failed("invalid evidence reference")))

    def by_container(live, norm):
        long_enough = F.length(norm) >= LITERAL_MIN
        holders = F.filter(live, lambda e: long_enough & F.contains(e.norm, norm))
        shortest = lambda h: let(F.array_min(F.transform(h, lambda e: F.length(e.norm))), lambda n: F.filter(
            h, lambda e: F.length(e.norm) == n))
        return let(holders, lambda h: F.when(F.size(h) == 0, by_run(live, norm, long_enough)).otherwise(let(
            shortest(h), lambda b: F.when(F.size(b) == 1, found(F.get(b, 0)))
            .otherwise(failed("literal evidence is ambiguously contained in multiple spans")))))

    def by_text(live, norm):
        return let(F.filter(live, lambda e: e.norm == norm), lambda eq: F.when(norm == "", failed("empty evidence"))
                   .when(F.size(eq) == 1, found(F.get(eq, 0)))
                   .when(F.size(eq) > 1, failed("literal evidence matches multiple identical spans"))
                   .otherwise(by_container(live, norm)))

    raw = strip(F.coalesce("e", F.lit("")))
    by_id = let(F.upper(raw), lambda name: F.filter("_spans", lambda e: e.evidence_id == name))
    # Normal forms do not travel: they are made here, and only for a literal.
    normed = F.transform("_spans", lambda e: F.struct(e.span_no.alias("span_no"), e.evidence_id.alias("evidence_id"), e.span.alias("span"), norm_evidence(e.span).alias("norm")))
    hit = F.when(F.col("_spans").isNull(), failed("no evidence catalogue for slot")).otherwise(let(by_id, lambda x: F.when(
        F.size(x) > 0, found(F.get(x, 0))).otherwise(let(F.filter(normed, lambda e: e.norm != ""), lambda live: let(
            norm_evidence(raw), lambda norm: by_text(live, norm))))))
    return (p.withColumn("_hit", hit).withColumns({
        "reason": F.coalesce("reason", F.col("_hit.why")), "evidence_ids": F.col("_hit.ids"), "evidence": F.col("_hit.text")})
        .drop("_spans", "_hit"))


def assemble_questions(items: DataFrame, answers: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """Resolved items to questions with four options, or a reason.

    ``items``: output of ``resolve_evidence``; ``answers``: request_id, slot, answer_id, evidence_id, answer;
    ``pools``: request_id, slot, pool.  Items with ``a`` or ``d`` name an answer of the catalogue, others bring
    four options and a key.
    """
    cat = answers.select("request_id", F.col("slot").cast("string").alias("slot"), "answer_id", "evidence_id", "answer")
    # The answers of a slot travel as one array, in which the named one is looked up: the catalogue is made once.
    held = cat.groupBy("request_id", "slot").agg(F.array_sort(F.collect_list(F.struct("answer_id", "answer", "evidence_id"))).alias("_cat"))
    p = items.withColumn("answer_id", F.upper(strip(F.coalesce("a", F.lit(""))))).join(held, ["request_id", "slot"], "left")
    p = p.select("*", F.transform("_cat", lambda x: x.answer).alias("_near"), F.explode_outer(F.filter("_cat", lambda x: x.answer_id == F.col("answer_id"))).alias("_named"))
    p = p.withColumns({"answer": F.col("_named.answer"), "_home": F.col("_named.evidence_id")}).drop("_cat", "_named")
    p = (p.join(pools.select("request_id", F.col("slot").cast("string").alias("slot"), "pool"), ["request_id", "slot"], "left")
         if pools is not None else p.withColumn("pool", F.array().cast("array<string>")))
    stem, ev = strip(F.coalesce("q", F.lit(""))), F.col("evidence")
    by_answer = F.col("a").isNotNull() | F.col("d").isNotNull()
    three = pick_distractors(F.col("d"), F.col("answer"), ev, F.col("_near"), F.col("pool"))
    risky = relation(stem).isin(*HIGH_RISK)
    p = p.withColumns({"_three": F.when(by_answer, three), "_repaired": F.when(by_answer & risky, repair_high_risk(stem, F.col("answer"), ev)),
                       "_key": F.when(by_answer, correct_key(F.col("slot"))).otherwise(F.upper(strip(F.coalesce("c", F.lit("")))))})
    single = ~F.contains(F.coalesce("evidence_ids", F.lit("")), F.lit(","))
    legacy = F.transform("o", lambda x: strip(F.coalesce(x, F.lit(""))))
    why = (F.when(F.col("reason").isNotNull(), F.col("reason"))
           .when(by_answer & F.col("answer").isNull(), "invalid answer id")
           .when(by_answer & single & (F.col("_home") != F.col("evidence_ids")), "answer belongs to other evidence")
           .when(by_answer & ~strict_support(F.col("answer"), ev), "answer is not directly supported by selected evidence")
           .when(by_answer & (F.coalesce(F.size("d"), F.lit(0)) != 3), "item must have exactly three distractors")
           .when(by_answer & F.col("_three").isNull(), "could not produce exactly three safe distractors")
           .when(by_answer & risky & F.col("_repaired").isNull(), "high-risk relation could not be repaired")
           .when(by_answer, F.lit(None)).when(stem == "", "item is missing q")
           .when(F.coalesce(strip(ev), F.lit("")) == "", "item is missing e").when(~F.col("_key").isin(*KEYS), "key must be A-D")
           .when(F.coalesce(F.size("o"), F.lit(0)) != 4, "item must have exactly four options")
           .when(F.exists(legacy, lambda x: x == ""), "item has an empty option"))
    place = F.array_position(one_of(KEYS), F.col("_key")).cast("int")
    texts = F.when(by_answer, F.array_insert("_three", place, F.col("answer"))).otherwise(legacy)
    p = p.withColumn("reason", why).withColumn("_texts", F.when(F.col("reason").isNull(), texts))
    options = F.transform("_texts", lambda x, i: F.struct(
        F.element_at(one_of(KEYS), i + 1).alias("option_key"), x.alias("option_text"),
        (F.element_at(one_of(KEYS), i + 1) == F.col("_key")).alias("is_correct"), (i + 1).alias("position")))
    return p.select("request_id", "slot", "reason", F.coalesce("_repaired", stem).alias("question_text"), "evidence",
                    F.col("evidence").alias("explanation"), options.alias("options"))


def check_cards(cards: DataFrame, allowed: DataFrame, n: int) -> DataFrame:
    """First ``n`` cards per request with an allowed source chunk and a new, non-empty front.

    ``cards``: request_id, position, source_chunk_id, front_text, back_text; ``allowed``: request_id, chunk_id.
    """
    ok = (cards.filter("source_chunk_id is not null").withColumn("_key", front_key(F.col("front_text"))).filter("_key <> ''")
          .join(allowed.select("request_id", F.col("chunk_id").alias("source_chunk_id")), ["request_id", "source_chunk_id"], "left_semi"))
    first = ok.groupBy("request_id", "_key").agg(F.min_by(
        F.struct("position", "source_chunk_id", "front_text", "back_text"), "position").alias("_c"))
    return top_per_key(first.select("request_id", "_c.*"), ["request_id"], [F.asc("position")], n, "card_order")
