"""Registered queries of the operators; each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from studyloom.llm import anchors, crf, kneser_ney, licenses, packing, pivots, ppm, simhash, suffix_automaton, transducer, url_cascade, variants, word_bpe
from studyloom.llm.common import LOWER, UPPER, among, fold_of, stored
from studyloom.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

OP1_SQL = f"""
with rules(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                           ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as n from pages),
fit as (select n, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
        from p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join fit using (n)
"""


@query("op1_url_cascade", OP1_SQL)
def url_filter(read):
    """Host, path, longest rule and verdict of every page."""
    pages = read("pages")
    rules = pages.sparkSession.createDataFrame(url_cascade.RULES, "host string, path string, verdict string")
    return url_cascade.judge(pages, rules)


@query("op4_simhash")
def simhash_groups(read):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read("documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")



OP2_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
                     where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join link l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a), degree as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join least on vec_id = least.a left join degree on vec_id = degree.a
"""


@query("op2_pivot_permutation", OP2_SQL)
def embedding_groups(read):
    """Links and component of every vector."""
    return pivots.near_duplicates(read("embeddings"))


def trusted_texts(docs, labels):
    """(lang, text) of the documents whose label says good quality."""
    return among(docs.select("doc_id", "lang", "text"), labels.where("quality = 1")).select("lang", "text")


@query("op3_kneser_ney")
def quality(read):
    """Perplexity of every document under the model of its language, the language's bounds, and whether it stays."""
    docs = read("documents")
    return kneser_ney.judge(docs, trusted_texts(docs, read("labels")))


@query("op5_license_scan")
def license_notices(read):
    """Licence family of every paragraph that is or looks like a licence notice."""
    return licenses.scan(read("documents"))


def digests(decoded):
    """Number and digest of ids, and digest of the text they decode to."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op6_word_bpe")
def encoding(read):
    """Number and digest of the ids of every document, and digest of what they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return digests(word_bpe.decode(word_bpe.encode(read("documents"), path), path))


def learning_texts(docs):
    """(lang, text) that language ID may learn from: every fold but one."""
    return docs.where(F.col("lang").isNotNull() & (fold_of("doc_id", 4) != 2)).select("lang", "text")


@query("op7_ppm_language")
def language(read):
    """Predicted language of every document."""
    docs = read("documents")
    found = ppm.identify(docs, learning_texts(docs))
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op8_transducer_counts")
def token_counts(read):
    """Bytes and tokens of every document."""
    found = transducer.count_tokens(read("documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > transducer.LIMIT).alias("over_limit"))


OP9_SQL = rf"""
with words as (select doc_id, row_number() over () as n, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
items as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
windows as (select distinct item, least(len(w), 10) as size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as g
            from items, lateral (select unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i) where len(w) > 0),
spots as (select n, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') as g
       from words, (select distinct size from windows), lateral (select unnest(range(1, len(w) - size + 2)) as i)),
met as (select spots.n, spots.i, spots.size, item from spots join windows using (g, size)),
hit as (select n, count(distinct p) as n_hit from (select n, unnest(range(i, i + size)) as p from met) group by n),
named as (select n, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as digest from (select distinct n, item from met) group by n)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(digest, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated from words left join hit using (n) left join named using (n)
"""


@query("op9_suffix_automaton", OP9_SQL)
def decontamination(read):
    """Words inside benchmark windows, and the items met, for every document."""
    found = suffix_automaton.match(read("documents"), read("benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@query("op10_crf_toxicity")
def toxic_documents(read):
    """Toxicity score of every document."""
    labels = read("labels").where(fold_of("doc_id", 5) != 0).select("doc_id", "toxic")
    found = crf.toxicity(read("documents"), labels)
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _op13_sql() -> str:
    """The rounds written out: nearest entry of every part, then the floor of the mean of what it owns."""
    near = """{name} as materialized (select part, n, v, arg_min(entry, struct_pack(d := d, entry := entry)) as entry, min(d) as d from (
        select p.part, p.n, p.v, b.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) ** 2))::bigint as d from parts p join {book} b using (part)) group by all)"""
    new = """{name} as materialized (select part, entry, coalesce(m.v, o.v) as v from {book} o left join (select part, entry, list(floor(s / c)::bigint order by i) as v from (
        select part, entry, i, sum(v[i])::hugeint as s, count(*) as c from {near}, (select unnest(range(1, (select max(len(v)) from parts) + 1)) as i) group by part, entry, i) group by part, entry) m using (part, entry))"""
    ctes = ["""kept as materialized (select row_number() over (order by vec_id, embedding) as n, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
            "parts as materialized (select n, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] as v from kept, (select unnest(range(8)) as part))",
            "b0 as (select part, n - 1 as entry, v from parts where n <= 16)"]
    for r in range(anchors.ROUNDS):
        ctes += [near.format(name=f"a{r}", book=f"b{r}"), new.format(name=f"b{r + 1}", near=f"a{r}", book=f"b{r}")]
    last = f"b{anchors.ROUNDS}"
    ctes += [near.format(name="fin", book=last), "coded as (select n, string_agg(lpad(format('{:x}', entry), 2, '0'), '' order by part) as code, sum(d)::bigint as error from fin group by n)",
             f"digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from {last})"]
    return "with " + ", ".join(ctes) + """ select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from kept join coded using (n), digest"""


@query("op13_anchors_codes", _op13_sql())
def vector_codes(read):
    """Code and error of every vector, and the error of its label."""
    coded = stored(anchors.compress(read("embeddings")))
    return anchors.with_label_error(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op11_sum_of_squares_packing")
def packed_sequences(read):
    """Sequence and place of every piece of every document."""
    return packing.pack(read("documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op12_variable_grams")
def spelling_variants(read):
    """Form and root of every word."""
    return variants.group_variants(read("documents"))
