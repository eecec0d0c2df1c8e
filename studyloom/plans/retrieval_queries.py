"""Queries on chunks, retrieval, quiz sources and raw items (C3-C6, X, K, W7-W12, N13-N36)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from studyloom.functions import questions as qn, text as tx
from studyloom.operators import access, chunking, contexts as ctx, indexed_search as ix, items as it, lists, planning, retrieval as rt
from studyloom.operators.numbering import unfold
from studyloom.plans import cloze
from studyloom.plans.registry import query
from studyloom.plans.text_queries import BOOK, TEXT, books, lines, pairs, re_, s, s_cmp, s_ev, s_squeeze, s_strip, texts
from studyloom.plans.views import oracle
from studyloom.session import checkpoint_dir, spread
from studyloom.sources.search_index import SearchIndex
from studyloom.sources.vector_cells import VectorCells

# ------------------------------------------------------------------------------------ C3-C6
# One step of the sizing rule per round: the last break inside the window, then the aligned overlap.
STEPS = """, steps as (select doc_id, t, n, 0 as k, 0::bigint as st, case when n <= 1800 then n else h end as en from (select doc_id, t, n,
    case when length(regexp_extract(substr(t, 1117, 684), '(?s)^.*(?:\\n|[.!?;]\\s+)')) > 0 then 1116 + length(regexp_extract(substr(t, 1117, 684), '(?s)^.*(?:\\n|[.!?;]\\s+)'))
      when contains(substr(t, 1117, 684), ' ') then 1116 + 684 - instr(reverse(substr(t, 1117, 684)), ' ') else 1800 end as h from src)
  union all select doc_id, t, n, k + 1, b, case when n <= b + 1800 then n else
    case when length(regexp_extract(substr(t, b + 1117, 684), '(?s)^.*(?:\\n|[.!?;]\\s+)')) > 0 then b + 1116 + length(regexp_extract(substr(t, b + 1117, 684), '(?s)^.*(?:\\n|[.!?;]\\s+)'))
      when contains(substr(t, b + 1117, 684), ' ') then b + 1116 + 684 - instr(reverse(substr(t, b + 1117, 684)), ' ') else b + 1800 end end
  from (select doc_id, t, n, k, case when b1 <= st then en else b1 end as b from (select doc_id, t, n, k, st, en,
      p + length(regexp_extract(substr(t, p + 1, en - p), case when regexp_matches(substr(t, p, 2), '\\s') then '^\\s*' else '^\\S*\\s*' end)) as b1
    from (select *, en - 250 as p from steps where en < n))))
"""
CHUNK_SRC = f"with recursive src as (select doc_id, t, length(t)::bigint as n from (select doc_id, {s_strip(re_('text', '[ ' + chr(9) + ']+', ' '))} as t from documents) where t <> '')" + STEPS


@query("sized_chunks", CHUNK_SRC + f"select doc_id as document_id, cast(row_number() over (partition by doc_id order by st) - 1 as integer) as chunk_index, {s_strip('substr(t, st + 1, en - st)')} as content from steps")
def sized_chunks(t):
    b = chunking.blocks(texts(t).select(F.col("doc_id").alias("document_id"), tx.clean_text(F.col("text")).alias("content")))
    return chunking.chunk_blocks(b).select("document_id", F.col("_pos").alias("chunk_index"), "content")


NO_SECTIONS = "id long, document_id long, title string, section_order int"


@query("document_chunks", CHUNK_SRC + f"""select document_id, chunk_index, length(content) as char_count, cast(greatest(1, length(content) // 4) as integer) as token_count, sha256(content) as content_hash from
    (select doc_id as document_id, cast(row_number() over (partition by doc_id order by st) - 1 as integer) as chunk_index, {s_strip('substr(t, st + 1, en - st)')} as content from steps)""")
def document_chunks(t):
    docs = texts(t).select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return chunking.chunk_documents(docs, outline(t)).select("document_id", "chunk_index", "char_count", "token_count", "content_hash")


def outline(t):
    """Three section titles per document, taken from words of its lines."""
    title = F.array_join(F.slice(F.split("line", " "), 2, 3), " ")
    return lines(t).filter("line_no % 4 = 1").select((F.col("doc_id") * 1000 + F.col("line_no")).alias("id"), F.col("doc_id").alias("document_id"),
                                                    title.alias("title"), F.expr("cast(line_no div 4 as int)").alias("section_order"))


NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower(replace({}, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"
SECTIONS = {**BOOK, "outline": (("lines",), f"""select id, document_id, ord, title, list_filter(string_split(title, ' '), lambda x: length(x) >= 2 and x not in {tuple(chunking.TITLE_STOP)}) as toks from (
      select doc_id * 1000 + line_no as id, doc_id as document_id, case when line_no // 4 = 0 then 999999 else line_no // 4 end as ord,
        {NORM.format("array_to_string(string_split(line, ' ')[2:4], ' ')")} as title from lines where line_no % 4 = 1)"""),
    "nb": (("blocks",), f"select doc_id, block_index, heading, ch, {NORM.format('content')} as txt, {NORM.format('coalesce(heading, chr(32))')} as hd from blocks"),
    "points": (("nb", "outline"), """select b.*, o.id, o.ord, case when o.title <> '' and contains(txt, o.title) then 120 else 0 end
      + coalesce(list_sum(list_transform(o.toks, lambda x: case when list_contains(string_split(hd, ' '), x) then 22 else 0 end + case when list_contains(string_split(txt, ' '), x) then 4 else 0 end)), 0)
      + coalesce(list_sum(list_transform(range(1, len(o.toks)), lambda i: case when contains(hd, o.toks[i] || ' ' || o.toks[i + 1]) then 28 when contains(txt, o.toks[i] || ' ' || o.toks[i + 1]) then 8 else 0 end)), 0) as pts
      from nb b left join outline o on o.document_id = b.doc_id"""),
    "own": (("points",), """select doc_id, block_index, heading, ch, case when heading is not null and max(pts) > 0 then arg_max(id, (pts, -ord, id)) end as own from points group by 1, 2, 3, 4""")}


@query("section_assignment", oracle("own", """select doc_id as document_id, block_index, case when heading is null then null else
    first_value(own ignore nulls) over (partition by doc_id, heading is null, ch order by block_index rows between unbounded preceding and current row) end as section_id from own""", SECTIONS))
def section_assignment(t):
    return chunking.assign_sections(chunking.blocks(books(t)), outline(t)).select("document_id", "block_index", "section_id")


@query("book_chunks")
def book_chunks(t):
    """C5 on documents with chapters and an outline."""
    return chunking.chunk_documents(books(t), outline(t))


PACKED = f"""with recursive line as (select doc_id, i, {s_strip('l')} as p from (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as l from (select doc_id, string_split(text, chr(10)) as l from documents))),
  piece as (select doc_id, i, 0 as k, p, false as alone from line where p <> '' and length(p) <= {chunking.SIZE} union all
    select doc_id, i, k, {s_strip(f'substr(p, cast(k as bigint) + 1, {chunking.SIZE})')}, true from line, lateral (select unnest(range(0, length(p), {chunking.SIZE - chunking.OVERLAP})) as k) where length(p) > {chunking.SIZE}),
  numbered as materialized (select *, row_number() over (partition by doc_id order by i, k) as n from piece where p <> ''),
  packed as (select doc_id, n, 0 as c, length(p) as size, alone from numbered where n = 1 union all
    select x.doc_id, x.n, y.c + case when y.alone or x.alone or y.size + 2 + length(x.p) > {chunking.SIZE} then 1 else 0 end,
      case when y.alone or x.alone or y.size + 2 + length(x.p) > {chunking.SIZE} then length(x.p) else y.size + 2 + length(x.p) end, x.alone
    from packed y join numbered x on x.doc_id = y.doc_id and x.n = y.n + 1)
select doc_id as document_id, c as chunk_index, string_agg(p, chr(10) || chr(10) order by n) as content from packed join numbered using (doc_id, n) group by 1, 2"""


@query("packed_paragraphs", PACKED)
def packed_paragraphs(t):
    return chunking.pack_paragraphs(texts(t).select(F.col("doc_id").alias("document_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content")))


@query("context_windows")
def context_windows(t):
    return ctx.score_contexts(ctx.micro_contexts(texts(t).select(F.col("doc_id").alias("chunk_id"), "text")))


@query("evidence_spans")
def evidence_spans(t):
    return ctx.evidence_spans(texts(t).select("doc_id", "text"), ["doc_id"])


# ------------------------------------------------------------------------------------ X1-X4, K1, K2, K4, K5
SEARCH = {"sc": (("chunks", "ldocs"), """select c.id as chunk_id, c.document_id, c.content, d.owner_id, d.subject_id from chunks c
      join ldocs d on d.id = c.document_id where c.is_active and d.status = 'READY'"""),
    "asked": ((), """select item_id as question_id, item_id % 7 as owner_id, case when item_id % 3 = 0 then item_id % 7 end as subject_id,
      case when item_id % 3 = 1 then [item_id % 7 * 2, 10000] end as document_ids, array_to_string(string_split(text, ' ')[1:3], ' ') as q3,
      case when item_id % 4 = 3 then string_split(text, ' ')[1] || '%' || string_split(text, ' ')[3] else upper(array_to_string(string_split(text, ' ')[1:2], ' ')) end as q2 from benchmark"""),
    "inscope": (("asked", "sc"), """select a.question_id, s.*, a.q3, a.q2 from asked a join sc s on s.owner_id = a.owner_id and
      case when len(a.document_ids) > 0 then list_contains(a.document_ids, s.document_id) else a.subject_id is null or s.subject_id = a.subject_id end"""),
    "vq": (("asked",), "select a.question_id, e.embedding::double[] as v from asked a join embeddings e on e.vec_id = a.question_id"),
    "vhits": (("inscope", "vq", "vectors"), """select i.question_id, i.chunk_id, i.document_id, i.content, list_cosine_similarity(q.v, e.embedding::double[]) as score
      from inscope i join vq q on q.question_id = i.question_id join vectors e on e.chunk_id = i.chunk_id"""),
    "vtop": (("vhits",), "select * from (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank_order from vhits) where rank_order <= 5"),
    "qt": (("asked",), "select question_id, list_distinct(regexp_extract_all(lower(q3), '[\\p{L}\\p{N}_]+')) as terms from asked"),
    "cand": (("inscope", "qt"), """select i.question_id, i.chunk_id, i.document_id, i.content, t.terms, regexp_extract_all(lower(i.content), '[\\p{L}\\p{N}_]+') as toks
      from inscope i join qt t on t.question_id = i.question_id where len(t.terms) > 0"""),
    "tmatch": (("cand",), "select * from cand where list_has_all(toks, terms)"),
    "occ": (("tmatch",), """select question_id, chunk_id, terms, tok, pos, row_number() over (partition by question_id, chunk_id order by pos) as idx from
      (select question_id, chunk_id, terms, unnest(range(len(toks))) as pos, unnest(toks) as tok from tmatch) where list_contains(terms, tok)"""),
    "lastpos": (("occ",), """select o.question_id, o.chunk_id, o.pos as r, o.idx as ri, p.tok, max(p.pos) as lp, max(p.idx) as li from occ o join occ p on p.question_id = o.question_id
      and p.chunk_id = o.chunk_id and p.pos <= o.pos group by 1, 2, 3, 4, 5"""),
    "covers": (("lastpos", "qt"), """select l.question_id, l.chunk_id, r, ri, min(lp) as l, min(li) as li from lastpos l join qt t on t.question_id = l.question_id
      group by 1, 2, 3, 4, t.terms having count(*) = len(t.terms)"""),
    "tscore": (("covers",), """select question_id, chunk_id, sum(0.1::double / (1 + (r - l) - (ri - li))) as score from (select question_id, chunk_id, l, min(r) as r, min(ri) as ri, min(li) as li
      from covers group by 1, 2, 3) group by 1, 2"""),
    "thits": (("tmatch", "tscore"), "select m.question_id, m.chunk_id, m.document_id, s.score from tmatch m join tscore s on s.question_id = m.question_id and s.chunk_id = m.chunk_id"),
    "ttop": (("thits",), "select * from (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank_order from thits) where rank_order <= 5"),
    "stop": (("inscope",), """select * from (select question_id, chunk_id, document_id, 0.01::double as score, row_number() over (partition by question_id order by chunk_id) as rank_order
      from inscope where content ilike '%' || q2 || '%') where rank_order <= 5""")}


def asked(t):
    q = t.raw("benchmark").selectExpr(
        "item_id as question_id", "item_id % 7 as owner_id", "case when item_id % 3 = 0 then item_id % 7 end as subject_id",
        "case when item_id % 3 = 1 then array(item_id % 7 * 2, 10000) end as document_ids",
        "array_join(slice(split(text, ' '), 1, 3), ' ') as query",
        "case when item_id % 4 = 3 then concat(split(text, ' ')[0], '%', split(text, ' ')[2]) end as gap", "array_join(slice(split(text, ' '), 1, 2), ' ') as two")
    return q.withColumn("q2", F.when(F.col("question_id") % 4 == 3, F.col("gap")).otherwise(tx.upper_each(F.col("two")))).drop("gap", "two")


def with_vectors(t, how="inner"):
    return asked(t).join(t.raw("embeddings").selectExpr("vec_id as question_id", "embedding as vector"), "question_id", how)


def wide_chunks(t):
    """The chunk view over all cores, for work on whole contents."""
    return spread(t.chunks)


# Stored indexes of a folder, written once a session.
_INDEXED: dict[tuple[str, str, str], SearchIndex] = {}
_CELLS: dict[tuple[str, str], VectorCells] = {}


def cells_of(t):
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _CELLS:
        _CELLS[key] = rt.stored_cells(t.vectors, t.chunks, t.documents)
    return _CELLS[key]


def vector_top(t):
    hits = rt.vector_hits(with_vectors(t), t.vectors, t.chunks, t.documents, cells=cells_of(t))
    return hits.join(t.chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id")


@query("vector_search", oracle("vtop", "select question_id, chunk_id, document_id, round(score, 6) as score, rank_order from vtop where score >= 0.05", SEARCH))
def vector_search(t):
    out = rt.vector_search(with_vectors(t), t.vectors, t.chunks, t.documents, cells=cells_of(t))
    return out.select("question_id", "chunk_id", "document_id", F.round("score", 6).alias("score"), "rank_order")




def index_of(t, kind):
    """Index of words or of trigrams; each is written when it is asked first."""
    key = (t.spark.sparkContext.applicationId, t.folder, kind)
    if key not in _INDEXED:
        index = SearchIndex(t.spark, f"{checkpoint_dir(t.spark)}/search-{uuid.uuid4().hex}")
        owned = wide_chunks(t).join(t.documents.select(F.col("id").alias("document_id"), "owner_id"), "document_id")
        index.append(owned.select("owner_id", F.col("id").alias("chunk_id"), "content"), "all", (kind,))
        _INDEXED[key] = index
    return _INDEXED[key]


@query("indexed_terms", oracle("chunks ldocs", """select owner_id, term, count(*) as chunks, sum(n)::bigint as places from (select d.owner_id, c.id, unnest(regexp_extract_all(lower(c.content), '[\\p{L}\\p{N}_]+')) as term, 1 as n
    from chunks c join ldocs d on d.id = c.document_id) x group by owner_id, term""").replace("count(*) as chunks", "count(distinct id) as chunks"))
def indexed_terms(t):
    """Chunks and places of every term of an owner, from the stored postings."""
    held = index_of(t, "words").table("postings")
    return held.groupBy("owner_id", "term").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("positions")).alias("places"))


@query("indexed_grams", oracle("chunks ldocs", """select owner_id, gram, count(distinct id) as chunks from (select d.owner_id, c.id, substr(lower(c.content), i, 3) as gram
    from chunks c join ldocs d on d.id = c.document_id, lateral (select unnest(range(1, length(lower(c.content)) - 1)) as i)) x group by owner_id, gram"""))
def indexed_grams(t):
    """Chunks with every trigram of an owner, from the stored lists."""
    held = index_of(t, "grams").table("grams").groupBy("owner_id", "gram").agg(F.sum(F.size("ids")).alias("chunks"))
    text = lambda shift: F.decode(F.unhex(F.lpad(F.hex(F.shiftright("gram", shift).bitwiseAND(F.lit((1 << 21) - 1))), 8, "0")), "UTF-32")
    return held.select("owner_id", F.concat(text(42), text(21), text(0)).alias("gram"), "chunks")


@query("celled_vectors", oracle("chunks ldocs vectors", """select d.owner_id, count(*) as vectors from vectors v join chunks c on c.id = v.chunk_id join ldocs d on d.id = c.document_id
    where len(list_filter(v.embedding, lambda x: x <> 0)) > 0 group by 1"""))
def celled_vectors(t):
    """Vectors of every owner, from the stored cells."""
    return cells_of(t).table("centres").groupBy("owner_id").agg(F.sum("vectors").alias("vectors"))


@query("text_search", oracle("ttop", "select question_id, chunk_id, document_id, round(score, 6) as score, rank_order from ttop", SEARCH))
def text_search(t):
    out = ix.text_search(asked(t), index_of(t, "words"), t.chunks, t.documents)
    return out.select("question_id", "chunk_id", "document_id", F.round("score", 6).alias("score"), "rank_order")


@query("substring_search", oracle("stop", "select question_id, chunk_id, document_id, score, rank_order from stop", SEARCH))
def substring_search(t):
    """A third of the questions start with a backslash, which makes the letter after it stand for itself."""
    q = asked(t).withColumn("query", F.when(F.col("question_id") % 3 == 1, F.concat(F.lit("\\"), "q2")).otherwise(F.col("q2")))
    return ix.substring_search(q, index_of(t, "grams"), t.chunks, t.documents).select("question_id", "chunk_id", "document_id", "score", "rank_order")


WHOLE = {**SEARCH, "asked": ((), """select item_id as question_id, item_id % 7 as owner_id, cast(null as bigint) as subject_id, cast([] as bigint[]) as document_ids,
      text as q3, text as q2 from benchmark""")}


def asked_whole(t):
    """Whole benchmark texts as questions."""
    return t.raw("benchmark").selectExpr("item_id as question_id", "item_id % 7 as owner_id", "text as query")


@query("text_search_whole", oracle("ttop", "select question_id, chunk_id, document_id, round(score, 6) as score, rank_order from ttop", WHOLE))
def text_search_whole(t):
    out = ix.text_search(asked_whole(t), index_of(t, "words"), t.chunks, t.documents)
    return out.select("question_id", "chunk_id", "document_id", F.round("score", 6).alias("score"), "rank_order")


@query("substring_search_whole", oracle("stop", "select question_id, chunk_id, document_id, score, rank_order from stop", WHOLE))
def substring_search_whole(t):
    return ix.substring_search(asked_whole(t), index_of(t, "grams"), t.chunks, t.documents).select("question_id", "chunk_id", "document_id", "score", "rank_order")


@query("retrieval", oracle("vtop ttop stop asked", """, v as (select question_id, chunk_id, document_id, score, rank_order from vtop where question_id % 2 = 0),
    x as (select question_id, chunk_id, document_id, score, rank_order from ttop where question_id not in (select question_id from v)),
    y as (select question_id, chunk_id, document_id, score, rank_order from stop3 where question_id not in (select question_id from v union select question_id from x))
    select question_id, chunk_id, document_id, round(score, 6) as score, rank_order from (select * from v where score >= 0.05 union all select * from x union all select * from y)""", {
    **SEARCH, "stop": (("inscope",), "select 1 as one")}).replace(", v as (select question_id", """, stop3 as (select * from (select question_id, chunk_id, document_id, 0.01::double as score,
      row_number() over (partition by question_id order by chunk_id) as rank_order from inscope where content ilike '%' || q3 || '%') where rank_order <= 5), v as (select question_id""", 1))
def retrieval(t):
    """Even questions have a vector; the others start at text search."""
    q = with_vectors(t, "left").withColumn("vector", F.when(F.col("question_id") % 2 == 0, F.col("vector")))
    return rt.retrieve(q, t.chunks, t.documents, words=index_of(t, "words"), grams=index_of(t, "grams"), cells=cells_of(t)).select(
        "question_id", "chunk_id", "document_id", F.round("score", 6).alias("score"), "rank_order")


@query("citations", oracle("vtop", "select question_id, chunk_id, document_id, rank_order, round(round(score, 6), 4) as similarity, substr(content, 1, 400) as excerpt from vtop", SEARCH))
def citation_rows(t):
    c = lists.citations(vector_top(t))
    return c.select("question_id", "chunk_id", "document_id", "rank_order", F.round(F.col("similarity_score").cast("double"), 4).alias("similarity"), "excerpt")


@query("assembled_contexts", oracle("vtop", "select question_id, md5(string_agg('[SOURCE ' || rank_order || '] ' || content, chr(10) || chr(10) order by rank_order)) as digest from vtop group by 1", SEARCH))
def assembled_contexts(t):
    return lists.assemble_context(vector_top(t)).select("question_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("retrieval_answers", oracle("vtop asked", f"""select a.question_id, md5(coalesce({s(lists.ANSWER_HEAD)} || string_agg('• ' || v.content, chr(10) || chr(10) order by rank_order), {s(lists.ANSWER_NONE)})) as digest
    from asked a left join vtop v on v.question_id = a.question_id group by 1""", SEARCH))
def retrieval_answers(t):
    return lists.retrieval_answer(asked(t), vector_top(t)).select("question_id", F.md5(F.col("answer").cast("binary")).alias("digest"))


@query("deck_contexts", oracle("chunks", """select document_id as request_id, md5(string_agg('[CHUNK_ID=' || id || ']' || chr(10) || content, chr(10) || chr(10) order by chunk_index)) as digest
    from (select *, row_number() over (partition by document_id order by chunk_index) as rn from chunks where is_active) group by 1"""))
def deck_contexts(t):
    c = t.chunks.filter("is_active").withColumn("request_id", F.col("document_id"))
    return lists.assemble_deck_context(c).select("request_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# ------------------------------------------------------------------------------------ W7-W12
SOURCES = {**TEXT, "idx": (("chunks", "ldocs"), """select c.document_id as request_id, c.id, c.section_id, c.content, c.chunk_index, row_number() over (partition by c.document_id order by c.chunk_index) - 1 as idx,
      3 + c.document_id % 7 as q from chunks c join ldocs d on d.id = c.document_id where c.is_active and d.status = 'READY'"""),
    "tier": (("idx",), f"""select *, case when length({s_strip('content')}) >= 500 then 1 when length({s_strip('content')}) >= 200 then 2 else 3 end as tier from idx"""),
    "best": (("tier",), "select *, row_number() over (partition by request_id order by idx) - 1 as pos, count(*) over (partition by request_id) as n from (select *, min(tier) over (partition by request_id) as b from tier) where tier <= b"),
    "pick": (("best",), """select request_id, n, q, least(n, q) as k, cast(unnest(range(least(n, q))) as integer) as pick from (select distinct request_id, n, q from best)"""),
    "src": (("pick", "best"), """select p.*, b.id, b.section_id, b.content from pick p join best b on b.request_id = p.request_id
      and b.pos = case when p.k <= 1 then 0 else cast(round_even(p.pick * (p.n - 1) / (p.k - 1)::double, 0) as bigint) end"""),
    "slots": (("src",), """select request_id, id as chunk_id, section_id, turn, pick * (q // k) + least(pick, q % k) + turn as slot from (select *, unnest(range(q // k + case when pick < q % k then 1 else 0 end)) as turn from src)""")}


def requests(t):
    return t.documents.filter("status = 'READY'").selectExpr("id as request_id", "cast(3 + id % 7 as int) as question_count")


def request_chunks(t):
    scope = t.documents.selectExpr("id as request_id", "owner_id", "cast(null as bigint) as subject_id", "array(id) as document_ids")
    return access.usable_chunks(wide_chunks(t), t.documents, scope)


@query("ranked_sources", oracle("idx", """select request_id, id, row_number() over (partition by request_id order by case section_id when request_id * 2 + 1 then 0 when request_id * 2 then 1 else 999999 end, chunk_index) - 1 as idx
    from idx""", SOURCES))
def ranked_sources(t):
    ranks = t.documents.selectExpr("id as request_id", "posexplode(array(id * 2 + 1, id * 2)) as (rank, section_id)")
    return planning.order_by_section_rank(request_chunks(t), ranks).select("request_id", "id", "idx")


@query("question_slots", oracle("slots", "select request_id, slot, chunk_id, turn from slots", SOURCES))
def question_slots(t):
    return cloze.question_slots(request_chunks(t), requests(t)).select("request_id", "slot", "chunk_id", "turn")


@query("rotated_contexts", oracle("slots lines", """, c as (select doc_id as chunk_id, line_no + 1 as rank, line as text, count(*) over (partition by doc_id) as m from lines)
    select s.request_id, s.slot, s.chunk_id, c.rank, c.text from slots s join c on c.chunk_id = s.chunk_id and c.rank = s.turn % c.m + 1""", SOURCES))
def rotated_contexts(t):
    slots = cloze.question_slots(request_chunks(t), requests(t)).select("request_id", "slot", "chunk_id", "turn")
    c = lines(t).selectExpr("doc_id as chunk_id", "line_no + 1 as rank", "line as text")
    return planning.assign_contexts(slots, c).select("request_id", "slot", "chunk_id", "rank", "text")


@query("preselected_answers", oracle("slots lines", """, c as (select doc_id, 'A' || line_no as answer_id, (length(line) % 50)::double as score from lines where line_no % 3 <> 0),
    r as (select *, row_number() over (partition by doc_id order by score desc, answer_id) as rk, count(*) over (partition by doc_id) as m from c),
    u as (select *, row_number() over (partition by request_id, chunk_id order by slot) - 1 as u from slots)
    select u.request_id, u.slot, u.chunk_id as source_ref, r.answer_id, r.score from u join r on r.doc_id = u.chunk_id and r.rk = u.u % r.m + 1""", SOURCES))
def preselected_answers(t):
    slots = cloze.question_slots(request_chunks(t), requests(t)).select("request_id", "slot", F.col("chunk_id").alias("source_ref"))
    c = lines(t).selectExpr("doc_id as source_ref", "concat('A', line_no) as answer_id", "cast(length(line) % 50 as double) as score", "line_no % 3 <> 0 as usable")
    return planning.preselect_answers(slots, c).select("request_id", "slot", "source_ref", "answer_id", "score")


# ------------------------------------------------------------------------------------ N13, N18, N19, N33, N34
@query("answer_candidates")
def answer_candidates(t):
    return unfold(pairs(t), ["doc_id", "line_no"], qn.answer_candidates(F.col("evidence")), "pos", "answer")


@query("distractor_pools")
def distractor_pools(t):
    return it.distractor_terms(wide_chunks(t).filter("is_active")).select("section_id", "text", "_at.document_id", "_at.chunk_index")


@query("picked_distractors")
def picked_distractors(t):
    near = qn.answer_candidates(F.col("evidence"))
    p = pairs(t).withColumn("near", near)
    given = F.array(F.lit("Alpha beta"), F.col("answer"), F.concat(F.lit("W = "), F.col("line_no").cast("string")))
    pool = F.array(F.lit("Gamma"), F.lit("Delta ray"), F.lit("of the"))
    return p.select("doc_id", "line_no", qn.pick_distractors(given, F.col("answer"), F.col("evidence"), F.col("near"), pool).alias("three"))


@query("source_catalogue", oracle("lines", f""", k as (select doc_id % 50 as request_id, doc_id * 100000 + line_no as slot, doc_id // 50 as chunk_id, {s_ev('line')} as e from lines),
    f as (select request_id, chunk_id, e, min(slot) as first from k group by 1, 2, 3), n as (select *, 'S' || (row_number() over (partition by request_id order by first) - 1) as source_ref from f)
    select k.request_id, k.slot, n.source_ref from k join n on n.request_id = k.request_id and n.chunk_id = k.chunk_id and n.e = k.e""", TEXT))
def source_catalogue(t):
    c = lines(t).selectExpr("doc_id % 50 as request_id", "doc_id * 100000 + line_no as slot", "doc_id div 50 as chunk_id", "line as text")
    return it.source_catalogue(c).select("request_id", "slot", "source_ref")


@query("cloze_quiz")
def cloze_quiz(t):
    """A quiz for every READY document."""
    return cloze.build_cloze_quiz(request_chunks(t), requests(t))


@query("accepted_cloze_questions")
def accepted_cloze_questions(t):
    return cloze.accepted_questions(cloze.build_cloze_quiz(request_chunks(t), requests(t)))


@query("cloze_gate")
def cloze_gate(t):
    return cloze.gate_summary(cloze.build_cloze_quiz(request_chunks(t), requests(t)))


# ------------------------------------------------------------------------------------ N29-N32, N35, N36
@query("normalized_items", """select p_partkey as id, 'Q' || p_partkey as question_text, case when p_partkey % 4 = 0 then 'EASY' end as difficulty,
    case when p_partkey % 4 = 2 then 'question must contain exactly 4 options' end as reason, case when p_partkey % 4 <> 2 then
      array_to_string(list_transform([0, 1, 2, 3], lambda i: substr('ABCD', i + 1, 1) || ':' || p_name || i || ':' ||
        case p_partkey % 4 when 0 then i = p_size % 4 when 1 then i = 0 else i = 2 end), ';') end as options from part""")
def normalized_items(t):
    """Raw objects in four spellings: hint by letter, flags, three options, positions as letters."""
    opt = lambda i, body: body.replace("#", str(i))
    four = lambda body: "concat(" + ", ',', ".join(opt(i, body) for i in range(4)) + ")"
    item = F.expr(f"""case p_partkey % 4
        when 0 then concat('{{"question":"Q', p_partkey, '","difficulty":" easy ","answer":"', lower(substr('ABCD', p_size % 4 + 1, 1)), ' ","options":[', {four("concat('{\"text\":\"- ', p_name, '#\"}')")}, ']}}')
        when 1 then concat('{{"question_text":"Q', p_partkey, '","options":[', {four("concat('{\"option_text\":\"', p_name, '#\",\"is_correct\":', case when # = 0 then '\"Yes\"' else '0' end, '}')")}, ']}}')
        when 2 then concat('{{"text":"Q', p_partkey, '","options":[{{"text":"a"}},{{"text":"b"}},{{"text":"c"}}]}}')
        else concat('{{"text":"Q', p_partkey, '","correct_option":"a","options":[', {four("concat('{\"content\":\"', p_name, '#\",\"position\":\"', substr('CBAD', # + 1, 1), '\"}')")}, ']}}') end""")
    n = it.normalize_items(t.raw("part").select(F.col("p_partkey").alias("id"), item.alias("item")))
    text = F.array_join(F.transform("options", lambda o: F.concat_ws(":", o.option_key, o.option_text, o.is_correct.cast("string"))), ";")
    return n.withColumn("options", text)


@query("recovered_items", """select id, position, 'Q' || id || '-' || position as q from (select p_partkey as id, cast(unnest(range(3)) as integer) as position from part where p_partkey % 4 <> 3)""")
def recovered_items(t):
    """Batches that are valid, lack commas inside code fences, have trailing commas, or hold no items."""
    obj = lambda i, tail="": f"concat('{{\"q\":\"Q', p_partkey, '-{i}\",\"e\":\"a}}b\"{tail}}}')"
    content = F.expr(f"""case p_partkey % 4 when 0 then concat('{{"items":[', {obj(0)}, ',', {obj(1)}, ',', {obj(2)}, ']}}')
        when 1 then concat('```json\n{{"items": [', {obj(0)}, '\n', {obj(1)}, ' ', {obj(2)}, ']}}\n```')
        when 2 then concat('{{"items":[', {obj(0, ',')}, ',', {obj(1, ', ')}, ',', {obj(2)}, '') else '{{"cards": [' end""".replace("{{", "{").replace("}}", "}"))
    got = it.recover_items(t.raw("part").select(F.col("p_partkey").alias("id"), content.alias("content")))
    return got.select("id", "position", F.get_json_object("item", "$.q").alias("q"))


@query("resolved_slots", """select p_partkey // 5 as request_id, cast(p_partkey % 5 as integer) as position,
    case p_partkey % 5 when 0 then '0' when 1 then '1' when 2 then '2' when 3 then '9' else case when (p_partkey // 5) % 2 = 0 then '0' else '3' end end as slot,
    case when p_partkey % 5 = 3 then 'unexpected slot' when p_partkey % 5 = 4 and (p_partkey // 5) % 2 = 0 then 'duplicate slot' end as reason from part""")
def resolved_slots(t):
    item = F.expr("""case p_partkey % 5 when 0 then '{"slot":0,"q":"x"}' when 1 then '{"q":"y"}' when 2 then '{"slot_id":"2","q":"z"}' when 3 then '{"index":9,"q":"u"}'
        else case when (p_partkey div 5) % 2 = 0 then '{"slot":"0","q":"v"}' else '{"q":"w"}' end end""")
    rows = t.raw("part").select(F.expr("p_partkey div 5").alias("request_id"), F.expr("cast(p_partkey % 5 as int)").alias("position"), item.alias("item"))
    slots = t.raw("part").selectExpr("p_partkey div 5 as request_id", "cast(p_partkey % 5 as int) as slot")
    return it.resolve_slots(rows, slots).select("request_id", "position", "slot", "reason")


@query("chosen_slots", """select p_partkey // 5 as request_id, cast(p_partkey % 5 as integer) as position, case when p_partkey % 3 = 0 and p_partkey % 2 = 0 then 'E9' else 'E1' end as e,
    case when p_partkey % 3 = 0 and p_partkey % 2 = 0 then 'A9' else 'A1' end as a, case when p_partkey % 2 = 0 then 'x,y,z' end as d from part""")
def chosen_slots(t):
    """N31 with answers chosen beforehand: they override what items with distractors name, and those only."""
    item = F.expr("""concat('{"slot":"', p_partkey % 5, '","q":"x","e":"E1","a":"A1"', case when p_partkey % 2 = 0 then ',"d":["x","y","z"]' else '' end, '}')""")
    rows = t.raw("part").select(F.expr("p_partkey div 5").alias("request_id"), F.expr("cast(p_partkey % 5 as int)").alias("position"), item.alias("item"))
    slots = t.raw("part").selectExpr("p_partkey div 5 as request_id", "cast(p_partkey % 5 as int) as slot")
    chosen = t.raw("part").filter("p_partkey % 3 = 0").selectExpr("p_partkey div 5 as request_id", "cast(p_partkey % 5 as int) as slot", "'A9' as answer_id", "'E9' as evidence_id")
    return it.resolve_slots(rows, slots, chosen).select("request_id", "position", "e", "a", F.array_join("d", ",").alias("d"))


EVID = {**TEXT, "cat": (("lines",), f"select doc_id, line_no as n, 'E' || line_no as eid, line, {s_ev('line')} as e from lines"),
        "first2": ((), "select doc_id, string_split(text, chr(10))[-2] as l0, string_split(text, chr(10))[-1] as l1 from documents"),
        "ask": (("first2",), """select doc_id, coalesce(case doc_id % 5 when 0 then 'e1' when 1 then '  ' || l1 || ' ' when 2 then substr(l1, 3, 40) when 3 then l0 || '  ' || l1 else 'zz not there in any of the sources' end, '') as raw from first2"""),
        "ask2": (("ask",), f"select doc_id, upper({s_strip('raw')}) as id, {s_ev('raw')} as r from ask"),
        "runs": (("cat",), f"""select a.doc_id, a.n as f, b.n as t, b.n - a.n + 1 as len, {s_ev("string_agg(c.line, ' ' order by c.n)")} as e, string_agg(c.eid, ',' order by c.n) as ids
          from cat a join cat b on b.doc_id = a.doc_id and b.n between a.n and a.n + 3 join cat c on c.doc_id = a.doc_id and c.n between a.n and b.n and c.e <> '' where a.e <> '' and b.e <> '' group by 1, 2, 3, 4"""),
        "runfit": (("ask2", "runs"), """select a.doc_id, r.ids, rank() over (partition by a.doc_id order by len(string_split(r.ids, ',')), length(r.e)) as rk from ask2 a join runs r on r.doc_id = a.doc_id
          and (r.e = a.r or (length(a.r) >= 24 and contains(r.e, a.r)))"""),
        "hold": (("ask2", "cat"), """select a.doc_id, c.eid, rank() over (partition by a.doc_id order by length(c.e)) as rk from ask2 a join cat c on c.doc_id = a.doc_id and c.e <> ''
          where length(a.r) >= 24 and contains(c.e, a.r)"""),
        "evid": (("ask2", "cat", "hold", "runfit"), """select a.doc_id as request_id, case
          when exists (select 1 from cat c where c.doc_id = a.doc_id and c.eid = a.id) then a.id when a.r = '' then null
          when (select count(*) from cat c where c.doc_id = a.doc_id and c.e = a.r) = 1 then (select min(eid) from cat c where c.doc_id = a.doc_id and c.e = a.r)
          when (select count(*) from cat c where c.doc_id = a.doc_id and c.e = a.r) > 1 then null
          when (select count(*) from hold h where h.doc_id = a.doc_id) > 0 then case when (select count(*) from hold h where h.doc_id = a.doc_id and rk = 1) = 1 then (select min(eid) from hold h where h.doc_id = a.doc_id and rk = 1) end
          when (select count(*) from runfit h where h.doc_id = a.doc_id and rk = 1) = 1 then (select min(ids) from runfit h where h.doc_id = a.doc_id and rk = 1) end as evidence_ids from ask2 a""")}


@query("resolved_evidence", oracle("evid", "select request_id, evidence_ids from evid", EVID))
def resolved_evidence(t):
    """Literals from the last two lines of every text; the check tries runs of up to four lines, more than a literal of two can need."""
    l = lines(t)
    cat = l.selectExpr("doc_id as request_id", "'0' as slot", "line_no as span_no", "concat('E', line_no) as evidence_id", "line as span")
    split = F.split("text", "\n")
    two = texts(t).select("doc_id", F.get(split, F.size(split) - 2).alias("l0"), F.get(split, F.size(split) - 1).alias("l1"))
    e = F.expr("case doc_id % 5 when 0 then 'e1' when 1 then concat('  ', l1, ' ') when 2 then substr(l1, 3, 40) when 3 then concat(l0, '  ', l1) else 'zz not there in any of the sources' end")
    rows = two.select(F.col("doc_id").alias("request_id"), F.lit("0").alias("slot"), e.alias("e"), F.lit(None).cast("string").alias("reason"))
    return it.resolve_evidence(rows, cat).select("request_id", "evidence_ids")


@query("checked_cards", oracle("chunks", """, c as (select p_partkey // 50 as request_id, cast(p_partkey % 50 as integer) as position, case when p_partkey % 13 <> 0 then p_partkey // 2 end as source_chunk_id,
      case when p_partkey % 11 = 0 then '  ' else p_name end as front_text from part), ok as (select c.* from c join chunks k on k.id = c.source_chunk_id and k.is_active where trim(front_text) <> ''),
    f as (select *, row_number() over (partition by request_id, lower(trim(front_text)) order by position) as rn from ok)
    select request_id, position, source_chunk_id, front_text, card_order from (select *, row_number() over (partition by request_id order by position) as card_order from f where rn = 1) where card_order <= 10"""))
def checked_cards(t):
    cards = t.raw("part").selectExpr("p_partkey div 50 as request_id", "cast(p_partkey % 50 as int) as position", "case when p_partkey % 13 <> 0 then p_partkey div 2 end as source_chunk_id",
                                     "case when p_partkey % 11 = 0 then '  ' else p_name end as front_text", "p_brand as back_text")
    allowed = (t.raw("part").selectExpr("p_partkey div 50 as request_id", "p_partkey div 2 as chunk_id").distinct()
               .join(t.chunks.filter("is_active").select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"))
    return it.check_cards(cards, allowed, 10).drop("back_text")


@query("assembled_items")
def assembled_items(t):
    """N31 -> N32 -> N36 on items that name the first answer of the first line of every document."""
    span = lines(t).selectExpr("doc_id as request_id", "'0' as slot", "line_no as span_no", "concat('E', line_no) as evidence_id", "line as span")
    source = span.withColumn("source_ref", F.col("request_id"))
    answers = it.answer_catalogue(source).selectExpr("source_ref as request_id", "'0' as slot", "answer_id", "evidence_id", "answer")
    raw = texts(t).selectExpr("doc_id as request_id", "0 as position", "concat('{\"slot\":\"0\",\"q\":\"Which term is meant in text ', doc_id, '?\",\"e\":\"E0\",\"a\":\"A0\",\"d\":[\"Alpha ray\",\"Beta ray\",\"Gamma ray\"]}') as item")
    slots = texts(t).selectExpr("doc_id as request_id", "0 as slot")
    return it.assemble_questions(it.resolve_evidence(it.resolve_slots(raw, slots), span), answers)
