"""Queries over texts: cleaning, chunking, question rules (C, N).  The check SQL is put together from small parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import questions as qn, text as tx
from studyloom.operators import chunking, contexts as ctx, planning
from studyloom.plans.registry import query
from studyloom.plans.views import oracle
from studyloom.session import spread

# ------------------------------------------------------------------------------------ parts of check SQL
WORD_RE = r"[\p{L}\p{N}_]+"
BULLET_RE = r"^\s*(?:[•●▪◦]+|[-*]+)\s*"
NUMBER_RE = r"^\s*(?:[0-9]+(?:\.[0-9]+)*|[A-Za-z])[.)]\s*"


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re_(x, pattern, to="", flags="g"):
    return f"regexp_replace({x}, {s(pattern)}, {s(to)}, {s(flags)})"


def s_strip(x):
    return re_(x, r"^\s+|\s+$")


def s_squeeze(x):
    return s_strip(re_(x, r"\s+", " "))


def s_cmp(x):
    return re_(re_(f"lower({s_strip(x)})", r"\s+", " "), r"[.!?;,:\-]+$", "", "")


def s_ev(x):
    quotes = s("\"“”'‘’")
    return re_(f"trim(lower({s_strip(x)}), {quotes})", r"\s+", " ")


def s_words(x):
    return f"regexp_extract_all({x}, {s(WORD_RE)})"


def s_wc(x):
    return f"len({s_words(x)})"


def s_any(x, markers):
    return "(" + " or ".join(f"contains({x}, {s(m)})" for m in markers) + ")"


def s_starts(x, markers):
    return "(" + " or ".join(f"starts_with({x}, {s(m)})" for m in markers) + ")"


def s_in(x, values):
    return f"{x} in (" + ", ".join(map(s, values)) + ")"


def s_list(values):
    return "[" + ", ".join(map(s, values)) + "]"


def s_clean(x):
    c = s_squeeze(x)
    for p in (BULLET_RE, NUMBER_RE, BULLET_RE):
        c = s_strip(re_(c, p, "", ""))
    return f"trim({c}, ' ' || chr(9) || chr(13) || chr(10) || ',;:.!?-')"


def s_lang(x):
    low = f"lower({x})"
    vi = f"len(regexp_extract_all({low}, {s('[' + tx.VI_LETTERS + ']')}))"
    found = f"list_distinct(regexp_extract_all({low}, {s('[a-zA-ZÀ-ỹĐđ]+')}))"
    vw = f"len(list_intersect({found}, {s_list(tx.VI_WORDS)}))"
    ew = f"len(list_intersect({found}, {s_list(tx.EN_WORDS)}))"
    return f"case when {vi} >= 2 or {vw} >= 2 then 'VI' when {ew} >= 2 and {vi} = 0 and {vw} = 0 then 'EN' else 'UNKNOWN' end"


def s_relation(x):
    low = f"lower({s_strip(x)})"
    blank = f"contains({low}, '_____')"
    rules = " ".join(f"when {s_any(low, m)} then '{n}'" for n, m in qn.STEM_MARKERS)
    return (f"case when {blank} and {s_starts(low, qn.FORMULA_CLOZE)} then 'FORMULA' when {blank} and {s_starts(low, qn.FACT_CLOZE)}"
            f" then 'FACT' {rules} else 'FACT' end")


def s_standalone(x):
    a, n = s_clean(x), s_cmp(s_clean(x))
    return (f"case when {a} = '' then 'empty answer candidate' when {n} = '' then 'empty normalized answer candidate'"
            f" when {s_in(n, qn.DEICTIC)} then 'deictic/context-dependent answer fragment'"
            f" when {s_starts(n, qn.CONNECTORS)} then 'connector-led context-dependent answer' end")


def s_strict(o, e):
    on, en = s_ev(o), s_ev(e)
    return (f"case when {on} = '' or {en} = '' then false when contains({en}, {on}) then true"
            f" when {s_wc(on)} = 1 then list_contains({s_words(en)}, {s_words(on)}[1]) else false end")


# ------------------------------------------------------------------------------------ text tables
# Phrases put before real lines so that every rule meets cases; chosen by document and line number.
PHRASES = ("", "Mục đích của ", "Khi đó ", "- ", "Nguyên nhân: ", "The value of the ", "1.2) ", "Công thức nào W = c + v ", "khi nào ",
           "“", "Giá trị ", "yêu cầu nào phải ", "Tác động của ", "what is meant by ", "Điền cụm từ thích hợp vào chỗ trống: _____ ",
           "Tiền là ", "Vai trò gì ", "gồm những ", "•  ", "đó", "Fill in the appropriate formula: _____ ", "a) Label: ", "tạo ra ", "in order to ")

TEXT = {
    "lines": ((), """select doc_id, cast(unnest(range(len(l))) as integer) as line_no, unnest(l) as line
        from (select doc_id, string_split(text, chr(10)) as l from documents)"""),
    "probes": (("lines",), f"select doc_id, line_no, {s_list(PHRASES)}[1 + (doc_id + line_no) % {len(PHRASES)}] || line as text, line from lines"),
    "pairs": (("probes",), """select doc_id, line_no, text as evidence, case (doc_id + 3 * line_no) % 4
        when 0 then array_to_string(string_split(line, ' ')[1:2], ' ') when 1 then array_to_string(string_split(line, ' ')[2:5], ' ')
        when 2 then array_to_string(string_split(text, ' ')[1:1], ' ') else 'Zz ' || array_to_string(string_split(line, ' ')[3:11], ' ') end as answer
        from probes"""),
}


def texts(t):
    return spread(t.raw("documents"))


def lines(t):
    return texts(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def probes(t):
    pick = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("doc_id") + F.col("line_no")) % len(PHRASES) + 1).cast("int"))
    return lines(t).withColumn("text", F.concat(pick, "line"))


def pairs(t):
    part = lambda c, a, n: F.array_join(F.slice(F.split(c, " "), a, n), " ")
    n = (F.col("doc_id") + F.col("line_no") * 3) % 4
    answer = (F.when(n == 0, part("line", 1, 2)).when(n == 1, part("line", 2, 4)).when(n == 2, part("text", 1, 1))
              .otherwise(F.concat(F.lit("Zz "), part("line", 3, 9))))
    return probes(t).select("doc_id", "line_no", F.col("text").alias("evidence"), answer.alias("answer"))


# ------------------------------------------------------------------------------------ C0, N1-N6
@query("clean_text", f"""select doc_id, {s_strip(re_(re_("'  ' || text || chr(10) || chr(10) || chr(10) || chr(10) || lang || chr(9) || '  end '", "[ " + chr(9) + "]+", " "), chr(10) + "{3,}", chr(10) * 2))} as content
    from documents""")
def clean_text(t):
    return t.raw("documents").select("doc_id", tx.clean_text(F.concat(
        F.lit("  "), "text", F.lit("\n\n\n\n"), "lang", F.lit("\t\x00 end "))).alias("content"))


@query("normal_forms", oracle("probes", f"select doc_id, line_no, {s_cmp('text')} as compare_form, {s_ev('text')} as evidence_form, {re_('lower(' + s_strip('text') + ')', chr(92) + 's+', ' ')} as front_form from probes", TEXT))
def normal_forms(t):
    c = F.col("text")
    return probes(t).select("doc_id", "line_no", tx.norm_compare(c).alias("compare_form"), tx.norm_evidence(c).alias("evidence_form"),
                            tx.front_key(c).alias("front_form"))


@query("search_forms", oracle("probes", "select doc_id, line_no, trim(regexp_replace(regexp_replace(replace(replace(strip_accents(lower(replace(text, 'ß', 'ss'))), 'đ', 'd'), ' kttt ', ' kinh te thi truong '), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) as form from (select doc_id, line_no, text || ' kttt ' as text from probes)", TEXT))
def search_forms(t):
    return probes(t).select("doc_id", "line_no", tx.norm_search(F.concat("text", F.lit(" KTTT "))).alias("form"))


ROMANS = (("I", 1), ("IV", 4), ("VI", 6), ("ix", 9), ("XIV", 14), ("XL", 40), ("xlii", 42), ("XCIX", 99), ("12", 12), ("7", 7), ("MCM", 1900), ("B", None))


@query("chapter_numbers", f"""select o_orderkey as id, {'[' + ', '.join('null' if v is None else str(v) for _, v in ROMANS) + ']'}[1 + o_orderkey % {len(ROMANS)}] as chapter from orders""")
def chapter_numbers(t):
    number = F.element_at(F.array(*[F.lit(r) for r, _ in ROMANS]), (F.col("o_orderkey") % len(ROMANS) + 1).cast("int"))
    word = F.when(F.expr("o_custkey % 2 = 0"), "Chương ").otherwise("CHAPTER  ")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), tx.chapter_no(F.concat(word, number, F.lit(": "), "o_orderpriority")).alias("chapter"))


@query("language_hints", oracle("probes", f"select doc_id, line_no, {s_lang('text')} as hint from probes", TEXT))
def language_hints(t):
    return probes(t).select("doc_id", "line_no", tx.lang_hint(F.col("text")).alias("hint"))


# ------------------------------------------------------------------------------------ N7-N12, N14-N17, N20-N28
@query("stem_relations", oracle("probes", f"""select doc_id, line_no, relation, case when {s_ev('ev')} = '' then false
    when relation = 'PURPOSE' then {s_any(s_ev('ev'), qn.EVIDENCE_MARKERS['PURPOSE'])} when relation = 'REQUIREMENT' then {s_any(s_ev('ev'), qn.EVIDENCE_MARKERS['REQUIREMENT'])}
    else true end as carried from (select doc_id, line_no, {s_relation('text')} as relation, line || case when line_no % 2 = 0 then ' nhằm phải' else '' end as ev from probes)""", TEXT))
def stem_relations(t):
    ev = F.concat("line", F.when(F.col("line_no") % 2 == 0, " nhằm phải").otherwise(""))
    r = probes(t).withColumn("relation", qn.relation(F.col("text")))
    return r.select("doc_id", "line_no", "relation", qn.relation_in_evidence(F.col("relation"), ev).alias("carried"))


EQ_RE = r"(?:^|[^\p{L}\p{N}_])([A-Za-z][A-Za-z0-9']*\s*=\s*[A-Za-z0-9'().]+(?:\s*[+\-*/]\s*[A-Za-z0-9'().]+)*)"
FORMULA_TEXT = "line || ' trong đó W' || (doc_id % 3) || ' = c +  v, và W' || (doc_id % 3) || ' = k + m; T = ' || line_no || '.'"


@query("equations", oracle("lines", f"""select doc_id, line_no, array_to_string(list_transform(l, lambda x: trim({re_('x', chr(92) + 's+', ' ')}, ' ,;:.!?')), '|') as equations,
    lower(trim(string_split(l[1], '=')[1])) as lhs from (select doc_id, line_no, regexp_extract_all({FORMULA_TEXT}, {s(EQ_RE)}, 1) as l from lines)""", TEXT))
def equations(t):
    text = F.expr("concat(line, ' trong đó W', doc_id % 3, ' = c +  v, và W', doc_id % 3, ' = k + m; T = ', line_no, '.')")
    e = lines(t).withColumn("_e", qn.equations(text))
    return e.select("doc_id", "line_no", F.array_join("_e", "|").alias("equations"), qn.lhs(F.get("_e", 0)).alias("lhs"))


def s_short(a, e):
    an, en = s_cmp(s_clean(a)), s_cmp(s_squeeze(e))
    lit = f"regexp_escape({an})"
    head = rf"'^' || {lit} || '(?:\s+là(?:[^\p{{L}}\p{{N}}_]|$)|\s*:)'"
    later = rf"'(?:^|[^\p{{L}}\p{{N}}_])' || {lit} || '\s+(?:được gọi là|được hiểu là|có nghĩa là)(?:[^\p{{L}}\p{{N}}_]|$)'"
    return (f"case when {s_clean(a)} = '' or {s_squeeze(e)} = '' then 'empty answer/evidence' when {s_wc(s_clean(a))} not between 1 and 2 then null"
            f" when regexp_matches({en}, {head}) or regexp_matches({en}, {later}) then null"
            " else 'short concept answer is not explicitly defined/labeled by its evidence' end")


@query("answer_checks", oracle("pairs", f"""select doc_id, line_no, {s_clean('answer')} as cleaned, {s_standalone('answer')} as standalone, {s_short('answer', 'evidence')} as short_answer from pairs""", TEXT))
def answer_checks(t):
    a, e = F.col("answer"), F.col("evidence")
    return pairs(t).select("doc_id", "line_no", qn.clean_answer(a).alias("cleaned"), qn.standalone_issue(a).alias("standalone"),
                           qn.short_answer_issue(a, e).alias("short_answer"))


def s_score(a, e):
    a, e = s_strip(a), s_strip(e)
    n, plain = s_wc(a), s_strip(re_(e, NUMBER_RE, "", ""))
    label = s_strip(f"string_split({plain}, ':')[1]")
    low, at = f"lower({e})", f"instr(lower({e}), {s_ev(a)})"
    after = " or ".join(f"(instr({low}, {s(m)}) > 0 and {at} > instr({low}, {s(m)}))" for m in qn.TRANSITIONS)
    return f"""(case when {n} between 2 and 7 then 40 when {n} between 8 and 10 then 28 when {n} = 1 then 14 else 8 end
      + case when length({a}) <= 60 then 15 when length({a}) <= 90 then 6 else 0 end
      + case when contains({plain}, ':') and {s_ev(label)} = {s_ev(a)} then case when {s_wc(label)} >= 2 then 55 else 5 end else 0 end
      + case when contains({e}, '=') and contains({a}, '=') then 45 + case when {after} then 35 else 0 end else 0 end
      - case when {s_in(s_cmp(a), qn.GENERIC)} then 25 else 0 end)::double - length({a}) * 0.03::double"""


@query("answer_scores", oracle("pairs", f"select doc_id, line_no, round({s_score('answer', 'evidence')}, 4) as score from pairs", TEXT))
def answer_scores(t):
    return pairs(t).select("doc_id", "line_no", F.round(qn.candidate_score(F.col("answer"), F.col("evidence")), 4).alias("score"))


def s_loose(o, a, e):
    on, sn = s_ev(o), s_ev(f"{a} || ' ' || {e}")
    toks = f"list_filter({s_words(on)}, lambda w: length(w) >= 2 and not list_contains({s_list(qn.STOP)}, w))"
    hit = f"len(list_filter({toks}, lambda w: list_contains({s_words(sn)}, w)))"
    return (f"case when {on} = '' or {sn} = '' then false when contains({sn}, {on}) then true when len({toks}) = 0 then false"
            f" when len({toks}) = 1 then {hit} = 1 else {hit} >= 2 and {hit}::double / len({toks}) >= 0.67 end")


@query("support_checks", oracle("pairs", f"select doc_id, line_no, {s_strict('answer', 'evidence')} as strict, {s_loose('answer', chr(39) + chr(39), 'evidence')} as loose from pairs", TEXT))
def support_checks(t):
    a, e = F.col("answer"), F.col("evidence")
    return pairs(t).select("doc_id", "line_no", qn.strict_support(a, e).alias("strict"), qn.loose_support(a, F.lit(""), e).alias("loose"))


def s_label(x):
    u = s_strip(re_(s_squeeze(x), BULLET_RE, "", ""))
    n = s_cmp(u)
    return (f"({u} <> '' and {s_wc(u)} between 1 and 7 and not regexp_matches({u}, '[,;:!?]') and not ends_with({u}, '.') and {n} <> ''"
            f" and not {s_starts(n, qn.LABEL_BAD_STARTS)} and not {s_any(chr(39) + ' ' + chr(39) + ' || ' + n + ' || ' + chr(39) + ' ' + chr(39), qn.LABEL_BAD_INSIDE)}"
            f" and not list_has_any(list_transform({s_words(u)}, lambda w: lower(w)), {s_list(qn.LABEL_BAD_WORDS)}))")


@query("label_shapes", oracle("pairs", f"""select doc_id, line_no, {s_label('answer')} as label,
    ({s_squeeze('answer')} <> '' and ({s_starts('lower(' + s_squeeze('answer') + ')', qn.CLAUSE_STARTS)} or regexp_matches({s_squeeze('answer')}, '[.!?]$'))) as clause,
    ({s_squeeze('answer')} <> '' and (starts_with(ev, lower({s_squeeze('answer')}) || ':') or starts_with(ev, lower({s_squeeze('answer')}) || ' :'))) as label_evidence
    from (select *, lower({s_strip(re_(s_squeeze("answer || ': ' || evidence"), BULLET_RE, '', ''))}) as ev from pairs)""", TEXT))
def label_shapes(t):
    a = F.col("answer")
    return pairs(t).select("doc_id", "line_no", qn.is_label(a).alias("label"), qn.is_clause(a).alias("clause"),
                           qn.is_label_evidence(a, F.concat("answer", F.lit(": "), "evidence")).alias("label_evidence"))


@query("key_positions", "select o_orderkey as id, substr('ABCD', cast(1 + o_orderkey % 4 as integer), 1) as by_number, substr('ABCD', cast(1 + list_sum(list_transform(string_split(o_orderpriority, ''), lambda x: ascii(x))) % 4 as integer), 1) as by_text from orders")
def key_positions(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), qn.correct_key(F.col("o_orderkey").cast("string")).alias("by_number"),
                                  qn.correct_key(F.col("o_orderpriority")).alias("by_text"))


# The answer is cut out by position; the pattern tolerates other white space, as in the column function.
CLOZE = {**TEXT, "masked0": (("pairs",), f"""select *, list_filter(string_split_regex({s_strip('answer')}, '\\s+'), lambda x: x <> '') as toks from pairs"""),
         "masked1": (("masked0",), """select *, '(?is)^(.*?)' || array_to_string(list_transform(toks, lambda x: regexp_escape(x)), '\\s+') || '(.*)$' as pat from masked0"""),
         "masked": (("masked1",), f"""select *, case when len(toks) > 0 and regexp_matches({s_strip('evidence')}, pat) then
            regexp_extract({s_strip('evidence')}, pat, 1) || '_____' || regexp_extract({s_strip('evidence')}, pat, 2) end as masked from masked1"""),
         "win0": (("masked",), f"""select *, {s_squeeze('masked')} as w, instr({s_squeeze('masked')}, '_____') - 1 as b from masked"""),
         "win1": (("win0",), """select *, greatest(0, b - 95) as s0 from win0"""),
         "win2": (("win1",), """select *, least(length(w), s0 + 190) as e1, case when least(length(w), s0 + 190) - s0 < 190 then greatest(0, least(length(w), s0 + 190) - 190) else s0 end as s1 from win1"""),
         "win3": (("win2",), """select *, trim(substr(w, cast(s1 + 1 as bigint), cast(e1 - s1 as bigint))) as p from win2"""),
         "win4": (("win3",), """select *, case when s1 > 0 then '… ' || case when instr(p, ' ') > 0 and not contains(substr(p, 1, instr(p, ' ') - 1), '_____') then ltrim(substr(p, instr(p, ' ') + 1)) else p end else p end as p2 from win3"""),
         "wins": (("win4",), """select *, case when b < 0 or length(w) <= 190 then w when e1 < length(w) then
            case when instr(p2, ' ') > 0 then rtrim(substr(p2, 1, length(p2) - instr(reverse(p2), ' '))) else p2 end || ' …' else p2 end as win from win4"""),
         "stem0": (("wins",), f"""select *, {s_strip(re_(re_('win', r'^(\s*…\s*)(?:[•●▪◦]+|[-*]+)\s*', r'\1', ''), BULLET_RE, '', ''))} as body from wins"""),
         "stems": (("stem0",), f"""select *, case when {s_standalone('answer')} is null and body <> '' then
            case when contains(answer, '=') then case when {s_lang('evidence')} = 'EN' then {s(qn.CLOZE_PREFIX['formula', 'EN'])} else {s(qn.CLOZE_PREFIX['formula', 'VI'])} end
            else case when {s_lang('evidence')} = 'EN' then {s(qn.CLOZE_PREFIX['term', 'EN'])} else {s(qn.CLOZE_PREFIX['term', 'VI'])} end end || body end as stem from stem0""")}


@query("masked_evidence", oracle("wins", "select doc_id, line_no, masked, win as cloze_text from wins", CLOZE))
def masked_evidence(t):
    m = pairs(t).withColumn("masked", qn.mask(F.col("answer"), F.col("evidence")))
    return m.select("doc_id", "line_no", "masked", F.when(F.col("masked").isNotNull(), qn.cloze_window(F.col("masked"))).alias("cloze_text"))


@query("cloze_stems", oracle("stems", f"""select doc_id, line_no, stem, case when {s_in(s_relation('evidence'), qn.HIGH_RISK)} and stem is not null and not {s_in(s_relation('stem'), qn.HIGH_RISK)} then stem end as repaired from stems""", CLOZE))
def cloze_stems(t):
    a, e = F.col("answer"), F.col("evidence")
    return pairs(t).select("doc_id", "line_no", qn.cloze_stem(a, e).alias("stem"), qn.repair_high_risk(e, a, e).alias("repaired"))


@query("formula_options", oracle("lines", f"""select doc_id, line_no, case when line_no % 3 = 0 then 'W' || (doc_id % 3) || ' = c + v' when line_no % 3 = 1 then 'T = ' || line_no
      else {s_squeeze("replace(line, '=', '')")} end as formula, line_no % 3 = 0 as needs_context from lines""", TEXT))
def formula_options(t):
    """N25 on built options: lead-in words fall away; rewriting stems without a formula are found."""
    option = F.when(F.col("line_no") % 3 == 0, F.expr("concat('Trong  đó W', doc_id % 3, ' = c + v.')")).when(
        F.col("line_no") % 3 == 1, F.expr("concat('T = ', line_no)")).otherwise(F.regexp_replace("line", "=", ""))
    stem = F.when(F.col("line_no") % 3 == 0, F.expr("concat('Công thức W', doc_id % 3, ' được viết lại thành gì?')")).otherwise(F.col("line"))
    ev = F.expr("concat('Khi W', doc_id % 3, ' = c + v thì W', doc_id % 3, ' = k + m.')")
    fixed = qn.normalize_formula(option)
    return lines(t).select("doc_id", "line_no", fixed.alias("formula"), qn.rewrite_needs_context(stem, fixed, ev).alias("needs_context"))


ITEMS = {**CLOZE, "items0": (("stems",), """select doc_id, line_no, evidence, answer, case (doc_id + line_no) % 3 when 0 then coalesce(stem, 'What is this here?')
        when 1 then evidence else 'Which of the terms fits the source ' || line_no || '?' end as q,
      case (doc_id + line_no) % 5 when 0 then substr(evidence, 4) else 'Before. ' || evidence || '  after' end as source, 'Alpha ' || doc_id as d1, 'Beta ' || line_no as d2, case when line_no % 5 = 0 then array_to_string(string_split(evidence, ' ')[1:3], ' ') else 'the of value' end as d3 from stems"""),
    "fits": (("items0",), f"""select *, {s_cmp('q')} as qn, {s_cmp('answer')} as an, {s_strip('answer')} as ans, {s_lang('evidence')} as src, {s_lang('q')} as qlang,
      [{s_lang('answer')}, {s_lang('d1')}, {s_lang('d2')}, {s_lang('d3')}] as olang,
      [contains(answer, '=') or {s_strip('answer')} = '', contains(d1, '='), contains(d2, '='), contains(d3, '=') or {s_strip('d3')} = ''] as oskip from items0"""),
    "fit": (("fits",), f"""select *, case when qn = '' or an = '' then 'question/correct answer cannot be empty'
      when length(an) >= 3 and contains(qn, an) then 'question stem contains the correct answer verbatim'
      when {s_any('qn', qn.LIST_QUESTIONS)} and not {s_any('ans', qn.LIST_ANSWERS)} then 'list-style question has a non-list correct answer'
      when {s_any('qn', qn.FORMULA_QUESTIONS)} and not contains(ans, '=') then 'formula-style question has a non-formula correct answer'
      when {s_standalone('ans')} is not null then 'correct answer is not standalone: ' || {s_standalone('ans')}
      when {s_any('qn', qn.ROLE_QUESTIONS)} and {s_wc('ans')} <= 2 and not {s_any('an', qn.ROLE_ANSWERS)} then 'role/function question has an overly short nominal answer'
      when {s_any('qn', qn.TIME_QUESTIONS)} and {s_in('an', qn.TIME_BAD_ANSWERS)} then 'time question has a deictic non-standalone answer'
      when src in ('VI', 'EN') and qlang in ('VI', 'EN') and src <> qlang then 'question language does not match evidence language (' || qlang || '!=' || src || ')'
      when src in ('VI', 'EN') and len(list_filter([1, 2, 3, 4], lambda i: not oskip[i] and olang[i] in ('VI', 'EN') and olang[i] <> src)) > 0 then 'option language does not match evidence language' end as issue from fits"""),
    "gate": (("fit",), f"""select *, {s_relation('q')} as rel, {s_ev('evidence')} as evn, list_filter([case when {s_strict('d1', 'evidence')} then '''B''' end, case when {s_strict('d2', 'evidence')} then '''C''' end,
        case when {s_strict('d3', 'evidence')} then '''D''' end], lambda x: x is not null) as sup from fit"""),
    "verdicts": (("gate",), f"""select *, case when {s_strip('evidence')} = '' then 'fast gate missing evidence_quote' when length({s_strip('evidence')}) > 500 then 'fast gate evidence_quote is too long'
      when length(evn) < 8 or not contains({s_ev('source')}, evn) then 'fast gate evidence quote does not exist verbatim in SOURCE'
      when rel = 'PURPOSE' and not {s_any('evn', qn.EVIDENCE_MARKERS['PURPOSE'])} or rel = 'REQUIREMENT' and not {s_any('evn', qn.EVIDENCE_MARKERS['REQUIREMENT'])} then 'fast gate evidence does not contain the required semantic relation ' || rel
      when issue is not null then 'fast gate pedagogical fit failed: ' || issue when not {s_strict('answer', 'evidence')} then 'fast gate correct option lacks direct support in evidence'
      when len(sup) > 0 then 'fast gate found distractor(s) also directly supported by evidence: [' || array_to_string(sup, ', ') || ']' else 'OK' end as verdict from gate""")}


def items(t):
    """Question items built from lines: cloze stems, the evidence itself, or a plain question."""
    a, e = F.col("answer"), F.col("evidence")
    n = (F.col("doc_id") + F.col("line_no")) % 3
    stem = (F.when(n == 0, F.coalesce(qn.cloze_stem(a, e), F.lit("What is this here?"))).when(n == 1, e)
            .otherwise(F.concat(F.lit("Which of the terms fits the source "), F.col("line_no").cast("string"), F.lit("?"))))
    d3 = F.when(F.col("line_no") % 5 == 0, F.array_join(F.slice(F.split(e, " "), 1, 3), " ")).otherwise("the of value")
    texts = F.array(a, F.concat(F.lit("Alpha "), F.col("doc_id").cast("string")), F.concat(F.lit("Beta "), F.col("line_no").cast("string")), d3)
    options = F.transform(texts, lambda x, i: F.struct(F.element_at(F.array(*[F.lit(k) for k in qn.KEYS]), i + 1).alias("option_key"),
                                                       x.alias("option_text"), (i == 0).alias("is_correct")))
    # Some sources lack the beginning of what is quoted from them.
    source = F.when((F.col("doc_id") + F.col("line_no")) % 5 == 0, F.expr("substr(evidence, 4)")).otherwise(F.concat(F.lit("Before. "), e, F.lit("  after")))
    return pairs(t).select("doc_id", "line_no", e, a, stem.alias("q"), options.alias("options"), source.alias("source"))


@query("fit_issues", oracle("fit", "select doc_id, line_no, issue from fit", ITEMS))
def fit_issues(t):
    return items(t).select("doc_id", "line_no", qn.fit_issue(F.col("q"), F.col("options"), F.col("evidence")).alias("issue"))


@query("formula_fit_issues", oracle("lines", """select doc_id, line_no, case when (doc_id + line_no) % 4 = 0 then 'formula question is ambiguous because evidence contains multiple formulas for the same symbol'
    when (doc_id + line_no) % 4 = 3 then 'formula-style question has a non-formula correct answer' end as issue from lines""", TEXT))
def formula_fit_issues(t):
    """N26 on formula questions: two formulas of one symbol, two of one symbol with a context, formulas of two symbols, no formula."""
    n = (F.col("doc_id") + F.col("line_no")) % 4
    number = F.col("line_no").cast("string")
    evidence = F.concat(F.lit("W = c + v; "), F.when(n == 2, "T = k + ").otherwise("W = k + "), number)
    stem = F.when(n == 1, "Sau khi thay, công thức nào là đúng?").otherwise("Công thức nào là đúng?")
    answer = F.when(n == 3, "c và v").otherwise("W = c + v")
    options = F.array(*[F.struct(F.lit(k).alias("option_key"), x.alias("option_text"), F.lit(k == "A").alias("is_correct")) for k, x in zip(qn.KEYS, (answer, F.lit("W = c - v"), F.lit("W = c × v"), F.lit("W = c / v")))])
    return lines(t).select("doc_id", "line_no", qn.fit_issue(stem, options, evidence).alias("issue"))


@query("grounding_verdicts", oracle("verdicts", f"""select doc_id, line_no, verdict, {s_any('lower(verdict)', qn.DETERMINISTIC)} as final from verdicts""", ITEMS))
def grounding_verdicts(t):
    v = items(t).withColumn("verdict", qn.grounding_verdict(F.col("source"), F.col("q"), F.col("options"), F.col("evidence")))
    return v.select("doc_id", "line_no", "verdict", qn.is_deterministic_failure(F.col("verdict")).alias("final"))


@query("gate_counts", oracle("verdicts", "select verdict as reason, count(*) as items from verdicts group by 1", ITEMS))
def gate_counts(t):
    from studyloom.plans.cloze import gate_summary

    return gate_summary(items(t).select(qn.grounding_verdict(F.col("source"), F.col("q"), F.col("options"), F.col("evidence")).alias("verdict")))


# ------------------------------------------------------------------------------------ C1, C2, C7, C8, C10, A12
BOOK = {**TEXT, "book_lines": (("lines",), """select doc_id, line_no, line, line_no // 3 as b, (line_no // 3) % 4 as ch from lines"""),
        "parts": (("book_lines",), f"""select doc_id, b, ch, case when b > 0 or doc_id % 2 = 1 then 'CHAPTER ' || ch || ': Title' end as heading,
          {s_strip("case when b > 0 or doc_id % 2 = 1 then 'CHAPTER ' || ch || ': Title' || chr(10) else '' end || string_agg(line, chr(10) order by line_no)")} as content
          from book_lines group by 1, 2, 3"""),
        "blocks": (("parts",), "select *, row_number() over (partition by doc_id order by b) - 1 as block_index from parts where content <> ''")}


def books(t):
    """Documents with a chapter heading before every third line; even documents start with a title page."""
    split = F.split("text", "\n")
    text = F.transform(split, lambda x, i: F.concat(F.when((i % 3 == 0) & ((i > 0) | (F.col("doc_id") % 2 == 1)), F.concat(
        F.lit("CHAPTER "), (F.floor(i / 3) % 4).cast("string"), F.lit(": Title\n"))).otherwise(""), x))
    return texts(t).select(F.col("doc_id").alias("document_id"), F.array_join(text, "\n").alias("content"))


@query("structural_blocks", oracle("blocks", "select doc_id as document_id, block_index, heading, content from blocks", BOOK))
def structural_blocks(t):
    return chunking.blocks(books(t)).select("document_id", "block_index", "heading", "content")


@query("skipped_blocks", oracle("blocks", """select document_id, block_index, case when heading is not null and n <= 700 and later >= 500 and later >= 2 * n then 'repeated_short_chapter_summary'
    when heading is null and has and n <= 600 then 'short_preamble' end as skip_reason from (select doc_id as document_id, block_index, heading, length(content) as n,
    bool_or(heading is not null) over (partition by doc_id) as has, max(length(content)) over (partition by doc_id, case when heading is not null then ch end order by block_index rows between 1 following and unbounded following) as later from blocks)""", BOOK))
def skipped_blocks(t):
    return chunking.skip_reasons(chunking.blocks(books(t))).select("document_id", "block_index", "skip_reason")


@query("contents_pages", """select doc_id, contains(substr(u, 1, 700), 'TABLE OF CONTENTS') and len(regexp_extract_all(substr(u, 1, 700), 'CHƯƠNG')) >= 3 as toc from (
    select doc_id, upper(trim(case doc_id % 3 when 0 then 'Table of contents Chương 1 Chương 2 Chương 3 ' when 1 then 'Table of contents Chương 1 ' else 'Chương 1 Chương 2 Chương 3 ' end || text)) as u from documents)""")
def contents_pages(t):
    head = F.expr("case doc_id % 3 when 0 then 'Table of contents Chương 1 Chương 2 Chương 3 ' when 1 then 'Table of contents Chương 1 ' else 'Chương 1 Chương 2 Chương 3 ' end")
    return t.raw("documents").select("doc_id", planning.is_toc(F.concat(head, "text")).alias("toc"))


@query("cropped_texts", oracle("blocks", """, n as (select doc_id, count(*) filter (where heading is not null) as heads, max(length(content)) filter (where block_index = 0) as first_len from blocks group by 1),
    w as (select doc_id as d, string_agg(case when line_no % 3 = 0 and (line_no > 0 or doc_id % 2 = 1) then 'CHAPTER ' || ch || ': Title' || chr(10) else '' end || line, chr(10) order by line_no) as t from book_lines group by 1)
    select document_id, cut, safe_chars from (select w.d as document_id,
      (case when lead > 48 then heads >= 1 else heads >= 2 end) and length(safe) >= 140 as cut,
      case when (case when lead > 48 then heads >= 1 else heads >= 2 end) and length(safe) >= 140 then length(safe) else length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) end as safe_chars
    from (select *, case when regexp_matches(tt, '(?m)^CHAPTER') then length(regexp_extract(tt, '^((?s).*?)(?-s)(?m)^CHAPTER [0-9]: Title', 1)) else 0 end as lead,
        len(regexp_extract_all(tt, '(?m)^CHAPTER [0-9]: Title')) as heads,
        regexp_replace(regexp_extract(tt, case when starts_with(tt, 'CHAPTER ') or length(regexp_extract(tt, '^((?s).*?)(?-s)(?m)^CHAPTER [0-9]: Title', 1)) <= 48
          then '^((?s).*?CHAPTER [0-9]: Title.*?)(?-s)(?m)^CHAPTER [0-9]: Title' else '^((?s).*?)(?-s)(?m)^CHAPTER [0-9]: Title' end, 1), '\\s+$', '') as safe
      from (select d, t, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as tt from w)) w)""", BOOK))
def cropped_texts(t):
    return books(t).withColumn("_c", ctx.crop_boundary(F.col("content"))).select("document_id", F.col("_c.cut").alias("cut"), F.col("_c.safe_chars").alias("safe_chars"))


def s_density(x):
    v = s_strip(x)
    marks = " + ".join(f"case when contains(' ' || lower({v}) || ' ', {s(m)}) then {w} else 0 end" for m, w in ctx.MARKER_WEIGHTS)
    letters, upper = f"len(regexp_extract_all({v}, '\\p{{L}}'))", f"len(regexp_extract_all({v}, '\\p{{Lu}}'))"
    return f"""case when {v} = '' then -9999 else round((greatest(0, 5 - abs(length({v}) - 380) / 100.0::double) + {marks} + case when contains({v}, '=') then 3 else 0 end
      + case when regexp_matches({v}, '(?:^|\\s)[•●▪◦]\\s*') then 1.2 else 0 end + case when regexp_matches({v}, '(?:^|\\s)[0-9]+[.)]\\s+') then 0.8 else 0 end
      + least(2.0, len(regexp_extract_all({v}, '[.;:]')) * 0.35) - case when length({v}) < 120 and {upper} / greatest(1, {letters})::double > 0.7 then 5 else 0 end
      - case when length({v}) < 140 then 3 else 0 end)::double, 4) end"""


@query("context_scores", oracle("probes", f"select doc_id, line_no, {s_density('text')} as score from probes", TEXT))
def context_scores(t):
    return probes(t).select("doc_id", "line_no", ctx.context_score(F.col("text")).alias("score"))


@query("context_metrics", oracle("lines", """, sl as (select doc_id % 100 as request_id, doc_id as chunk_id, line as text, doc_id % 7 = 0 as cut, doc_id * 2 + 100 as o, doc_id + 50 as sf from lines),
    c as (select request_id, chunk_id, count(*) as n, max(o) as o, max(sf) as sf, max(cut::int) as b from sl group by 1, 2),
    k as (select request_id, sum(n) as slot_count, count(*) as unique_chunks, sum(o) as original_chars, sum(sf) as safe_chars, sum(b) as boundary_cuts from c group by 1),
    x as (select request_id, count(*) as unique_contexts, sum(length(text)) as micro_chars from (select distinct request_id, chunk_id, text from sl) group by 1)
    select k.*, x.unique_contexts, x.micro_chars, case when k.original_chars > 0 then round_even((1.0::double - x.micro_chars::double / k.original_chars) * 100, 2) else 0 end as compression_pct
    from k join x on x.request_id = k.request_id""", TEXT))
def context_metrics(t):
    slots = lines(t).selectExpr("doc_id % 100 as request_id", "doc_id as chunk_id", "line as text", "doc_id % 7 = 0 as cut",
                                "doc_id * 2 + 100 as original_chars", "doc_id + 50 as safe_chars")
    return ctx.context_metrics(slots, ["request_id"])
