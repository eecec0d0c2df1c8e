"""Column functions on question stems, answers, options and evidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from studyloom.functions.text import (BULLET, NOT_AFTER_WORD, NUMBERING, QUOTES, SPACE, collapse, has_any, lang_hint, let,
                                      literal_pattern, norm_compare, norm_evidence, one_of, squeeze, starts_with_any, strip,
                                      word_count, words)

EDGE = " \t\r\n,;:.!?"
BLANK = "_____"
KEYS = ("A", "B", "C", "D")

# ---------------------------------------------------------------------------------------------------
# Marker lists, prefixes and patterns that results must match.
# ---------------------------------------------------------------------------------------------------
FORMULA_CLOZE = ("điền công thức thích hợp vào chỗ trống:", "fill in the appropriate formula:")
FACT_CLOZE = ("điền cụm từ thích hợp vào chỗ trống:", "điền từ thích hợp vào chỗ trống:",
              "fill in the blank with the appropriate term:")
STEM_MARKERS = (
    ("PURPOSE", ("mục đích", "nhằm mục đích", "nhằm để", "để làm gì", "purpose", "aim of", "goal of")),
    ("REQUIREMENT", ("yêu cầu gì", "yêu cầu nào", "phải dựa trên", "phải tuân theo", "cần phải", "điều kiện nào",
                     "điều kiện gì", "requirement", "required to", "must be")),
    ("CAUSE", ("nguyên nhân", "nguồn gốc", "do đâu", "vì sao", "tại sao", "sinh ra", "gây ra", "cause", "origin", "why")),
    ("EFFECT", ("tác động", "ảnh hưởng", "hệ quả", "kết quả nào", "dẫn đến", "effect", "impact", "result in")),
    ("FORMULA", ("công thức nào", "biểu thức nào", "công thức tính", "được tính bằng công thức",
                 "được biểu diễn bằng công thức", "được thể hiện bằng công thức", "thể hiện bằng công thức nào",
                 "formula for", "which formula", "which equation", "equation for")),
    ("DEFINITION", ("khái niệm là gì", "được hiểu là gì", "được gọi là gì", "định nghĩa", "what is meant by",
                    "definition of", "defined as")),
)
HIGH_RISK = ("PURPOSE", "REQUIREMENT", "CAUSE", "EFFECT")
EVIDENCE_MARKERS = {
    "PURPOSE": ("mục đích", "nhằm", "để đạt", "hướng tới", "purpose", "aim", "in order to"),
    "REQUIREMENT": ("yêu cầu", "phải", "cần phải", "đòi hỏi", "require", "must"),
}
DEICTIC = ("khi đó", "lúc đó", "do đó", "vì vậy", "như vậy", "từ đó", "điều này", "điều đó", "trường hợp đó", "ở đó",
           "nó", "đó", "này")
CONNECTORS = ("khi đó ", "do đó ", "vì vậy ", "như vậy ", "từ đó ", "theo đó ", "đồng thời ")
RELATION_PHRASES = ("bao gồm", "gồm", "được gọi là", "được hiểu là", "là", "dẫn tới", "dẫn đến", "sinh ra")
TRANSITIONS = ("chuyển thành", "biến thành", "trở thành", "viết thành", "viết lại thành")
GENERIC = ("nội dung", "đặc điểm", "khái niệm", "yếu tố", "vấn đề", "trường hợp", "khi đó", "lúc đó", "do đó", "vì vậy",
           "điều này", "điều đó")
STOP = ("a", "b", "c", "d", "v", "m", "w", "the", "an", "of", "and", "or", "to", "in", "on", "for", "là", "và", "của",
        "cho", "trong", "theo", "một", "các", "những")
CLAUSE_STARTS = ("là ", "được ", "có ", "giúp ", "làm ", "thể hiện ", "tạo ", "tạo ra ", "tăng ", "giảm ", "đảm bảo ",
                 "phát triển ", "nhằm ", "khi ", "do ", "vì ", "sau khi ")
LABEL_BAD_STARTS = CLAUSE_STARTS + ("cộng với ", "trừ ", "và ", "hoặc ", "nhưng ", "phần ", "trong ", "ngoài ")
LABEL_BAD_INSIDE = (" là ", " được ", " có ", " nhằm ", " để ", " chính là ", " thể hiện ", " tạo ra ", " làm cho ",
                    " dẫn tới ", " dẫn đến ", " cộng với ", " lớn hơn đó ")
LABEL_BAD_WORDS = ("đó", "này", "ấy", "nó")
LIST_QUESTIONS = ("gồm những", "bao gồm những", "những yếu tố nào", "các yếu tố nào", "những gì", "các thành phần nào")
LIST_ANSWERS = (",", ";", " và ", " + ", "/")
FORMULA_QUESTIONS = ("công thức", "biểu thức", "phương trình")
FORMULA_CONTEXT = ("sau khi", "chuyển thành", "biến thành", "viết lại", "khi k", "chi phí sản xuất", "sau chuyển đổi",
                   "after", "substitution", "converted", "rewrite")
ROLE_QUESTIONS = ("vai trò gì", "vai trò nào", "tác dụng gì", "tác dụng nào", "chức năng gì", "chức năng nào")
ROLE_ANSWERS = ("phương tiện", "thước đo", "đảm bảo", "thực hiện", "tạo ra", "làm ", "giúp ", "dùng để", "nhằm ")
TIME_QUESTIONS = ("khi nào", "lúc nào", "trong trường hợp nào", "when ")
TIME_BAD_ANSWERS = ("khi đó", "lúc đó", "đó", "khi ấy")
REWRITE_QUESTIONS = ("viết lại thành gì", "được viết lại thành gì", "chuyển thành gì", "được chuyển thành gì",
                     "biến thành gì", "được biến thành gì", "rewrite", "rewritten as", "converted to")
DETERMINISTIC = ("pedagogical fit failed", "question stem contains the correct answer", "question language does not match",
                 "role/function question", "correct answer is not standalone", "list-style question",
                 "formula-style question", "formula question is ambiguous")
CLOZE_PREFIX = {("formula", "EN"): "Fill in the appropriate formula: ",
                ("formula", "VI"): "Điền công thức thích hợp vào chỗ trống: ",
                ("term", "EN"): "Fill in the blank with the appropriate term: ",
                ("term", "VI"): "Điền cụm từ thích hợp vào chỗ trống: "}
OPERAND = "[A-Za-z0-9'().]+"
EQUATION = (NOT_AFTER_WORD + f"[A-Za-z][A-Za-z0-9']*{SPACE}*={SPACE}*{OPERAND}"
            f"(?:{SPACE}*[+\\-*/]{SPACE}*{OPERAND})*")
FORMULA_LEAD = (f"(?iu)\\A(?:trong{SPACE}+đó|khi{SPACE}+đó|do{SPACE}+đó|từ{SPACE}+đó|suy{SPACE}+ra|ta{SPACE}+có"
                f"|công{SPACE}+thức(?:{SPACE}+là)?|biểu{SPACE}+thức(?:{SPACE}+là)?|where|therefore|thus)"
                f"{SPACE}*[:,\\-]?{SPACE}*")
FORMULA_SHAPE = f"\\A{SPACE}*([A-Za-z][A-Za-z0-9']*){SPACE}*={SPACE}*(.+?){SPACE}*\\z"
LEAD = f"\\A(?:{BULLET})?(?:{NUMBERING})?(?:{BULLET})?"
MAX_EVIDENCE, MIN_EVIDENCE = 500, 8
# ---------------------------------------------------------------------------------------------------


def _text(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def first_by(items: Column, key) -> Column:
    """Array elements whose key did not occur earlier, in order."""
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("x")))
    firsts = let(keyed, lambda all_: let(F.transform(all_, lambda z: z.k), lambda keys: F.filter(
        all_, lambda e, i: F.array_position(keys, e.k) == i + 1)))
    return F.transform(firsts, lambda e: e.x)


def relation(stem: Column) -> Column:
    """What the stem asks for; the first matching rule wins, cloze prefixes before all."""
    def first_match(low):
        blank = F.contains(low, F.lit(BLANK))
        out = F.when(blank & starts_with_any(low, FORMULA_CLOZE), "FORMULA").when(blank & starts_with_any(low, FACT_CLOZE), "FACT")
        for name, markers in STEM_MARKERS:
            out = out.when(has_any(low, markers), name)
        return out.otherwise("FACT")

    return let(F.lower(_text(stem)), first_match)


def relation_in_evidence(kind: Column, evidence: Column) -> Column:
    """Only PURPOSE and REQUIREMENT must be worded in the evidence."""
    ev = norm_evidence(evidence)
    out = F.when(ev == "", False)
    for name, markers in EVIDENCE_MARKERS.items():
        out = out.when(kind == name, has_any(ev, markers))
    return out.otherwise(True)


def equations(text: Column) -> Column:
    """Compact equations of a text, distinct after normalization."""
    found = lambda t: F.when(F.contains(t, F.lit("=")), F.regexp_extract_all(t, F.lit(f"({EQUATION})"), 1)).otherwise(F.array().cast("array<string>"))
    raw = let(F.coalesce(text, F.lit("")), found)
    tidy = F.filter(F.transform(raw, lambda x: strip(collapse(x), EDGE)), lambda x: norm_compare(x) != "")
    return first_by(tidy, norm_compare)


def lhs(equation: Column) -> Column:
    """Left-hand side, empty if there is no "="."""
    e = F.coalesce(equation, F.lit(""))
    return F.when(F.contains(e, F.lit("=")), F.lower(strip(F.substring_index(e, "=", 1)))).otherwise("")


def clean_answer(text: Column) -> Column:
    """Bullets, numbering and edge punctuation off."""
    return strip(strip(F.regexp_replace(squeeze(text), LEAD, "")), EDGE + "-")


def standalone_issue(answer: Column) -> Column:
    """Why an answer cannot stand alone; null if it can."""
    return let(clean_answer(answer), lambda a: let(norm_compare(a), lambda n: (
        F.when(a == "", "empty answer candidate").when(n == "", "empty normalized answer candidate")
        .when(n.isin(*DEICTIC), "deictic/context-dependent answer fragment")
        .when(starts_with_any(n, CONNECTORS), "connector-led context-dependent answer"))))


def short_answer_issue(answer: Column, evidence: Column) -> Column:
    """Answers of one or two words must be defined or labelled by the evidence."""
    def check(a, ev):
        n = word_count(a)
        lit_a, e = literal_pattern(norm_compare(a)), norm_compare(ev)
        defined = F.concat(F.lit("(?U)(?:\\A"), lit_a, F.lit(f"(?:{SPACE}+là\\b|{SPACE}*:))|(?:\\b"), lit_a,
                           F.lit(f"{SPACE}+(?:được gọi là|được hiểu là|có nghĩa là)\\b)"))
        return (F.when((a == "") | (ev == ""), "empty answer/evidence").when(~n.between(1, 2), F.lit(None))
                .when(F.rlike(e, defined), F.lit(None))
                .otherwise("short concept answer is not explicitly defined/labeled by its evidence"))

    return let(clean_answer(answer), lambda a: let(squeeze(evidence), lambda ev: check(a, ev)))


def unnumbered(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\A" + NUMBERING, ""))


def answer_candidates(span: Column) -> Column:
    """Short phrases of one evidence span that may serve as answers, in order of preference.

    Label before ":", quoted phrases, equations, complements of relation words, comma clauses; if none
    is usable, the first ten words.
    """
    numberless = lambda raw: F.regexp_replace(raw, r"\A" + NUMBERING, "")
    return let(squeeze(span), lambda raw: let(F.lower(raw), lambda low: let(numberless(raw), lambda plain: _candidates(raw, low, plain))))


def _candidates(raw: Column, low: Column, plain: Column) -> Column:
    """Of a squeezed text, its lower case and itself without a number: the only white space is single blanks inside."""
    none = F.array().cast("array<string>")
    label = F.when(F.contains(plain, F.lit(":")), F.array(F.substring_index(plain, ":", 1))).otherwise(none)
    marked = F.contains(raw, F.lit('"')) | F.contains(raw, F.lit("“")) | F.contains(raw, F.lit("”"))
    quoted = F.when(marked, F.regexp_extract_all(raw, F.lit('["“”]([^"“”]{2,100})["“”]'), 1)).otherwise(none)
    eq = F.regexp_extract_all(raw, F.lit(f"({EQUATION})"), 1)
    formula = F.when(~F.contains(raw, F.lit("=")), none).otherwise(let(
        eq, lambda e: F.when(F.size(e) > 0, e).otherwise(F.array(F.substring_index(raw, ".", 1)))))
    complements = F.concat(*[F.when(F.contains(low, F.lit(p)), F.regexp_extract_all(
        raw, F.lit(f"(?iu){NOT_AFTER_WORD}{p}{SPACE}+(.+?)(?=[,;.]|\\z)"), 1)).otherwise(none) for p in RELATION_PHRASES])
    mixed = lambda x: F.contains(x, F.lit("=")) & (F.regexp_count(x, F.lit("=")) >= 2) & has_any(F.lower(x), TRANSITIONS)
    # A separator of one character is split at without a pattern.
    clauses = F.split(F.replace(plain, F.lit(";"), F.lit(",")), ",")
    clauses = F.when(F.contains(plain, F.lit("=")), F.filter(clauses, lambda x: ~mixed(x))).otherwise(clauses)
    opening = F.regexp_extract(plain, f"\\A((?:[^ ]+ ){{0,9}}[^ ]+)", 1)
    return F.when(raw == "", none).otherwise(let(
        _usable(F.concat(label, quoted, formula, complements, clauses), low),
        lambda found: F.when(F.size(found) > 0, found).otherwise(_usable(F.array(opening), low))))


# What ``clean_answer`` takes off the start of a text without outer blanks; others need no replacement.
NUMBERED = r"\A *(?:[•●▪◦*\-]|\p{Nd}|[A-Za-z][.)])"


def _usable(items: Column, low: Column) -> Column:
    """Cleaned candidates of 2 to 110 characters and 1 to 14 words that occur in the span, distinct.

    Items are parts of a squeezed text with the lower case ``low``, so ``clean_answer`` and ``norm_evidence`` have no white space
    to collapse and only blanks to strip.
    """
    bare = lambda x: F.when(F.rlike(x, F.lit(NUMBERED)), F.regexp_replace(x, LEAD, "")).otherwise(x)
    norm = lambda c: strip(c, QUOTES)

    def keep(ev):
        tidy = F.transform(items, lambda x: strip(bare(x), EDGE + "-"))
        short = F.filter(tidy, lambda x: F.length(x).between(2, 110) & let(word_count(x), lambda n: n.between(1, 14)))
        keyed = F.transform(short, lambda x: F.struct(norm(F.lower(x)).alias("n"), x.alias("x")))
        return F.filter(keyed, lambda e: (e.n != "") & F.contains(ev, e.n))

    return let(let(norm(low), keep), lambda kept: F.when(F.size(kept) > 1, first_by(kept, lambda e: e.n)).otherwise(kept)).getField("x")


def candidate_score(answer: Column, evidence: Column) -> Column:
    """Preference among answer candidates."""
    return let(_text(answer), lambda a: let(_text(evidence), lambda ev: let(unnumbered(ev), lambda plain: _score(a, ev, plain))))


def _score(a: Column, ev: Column, plain: Column) -> Column:
    n, size = word_count(a), F.length(a)
    score = F.when(n.between(2, 7), 40.0).when(n.between(8, 10), 28.0).when(n == 1, 14.0).otherwise(8.0)
    score = score + F.when(size <= 60, 15.0).when(size <= 90, 6.0).otherwise(0.0)
    label = strip(F.substring_index(plain, ":", 1))
    is_label = F.contains(plain, F.lit(":")) & (norm_evidence(label) == norm_evidence(a))
    score = score + F.when(is_label, F.when(word_count(label) >= 2, 55.0).otherwise(5.0)).otherwise(0.0)

    def transition(low, at):
        after = F.lit(False)
        for m in TRANSITIONS:
            after = after | ((F.instr(low, m) > 0) & (at > F.instr(low, m)))
        return F.when(after, 80.0).otherwise(45.0)

    both = F.contains(ev, F.lit("=")) & F.contains(a, F.lit("="))
    formula = let(F.lower(ev), lambda low: let(_find(low, norm_evidence(a)), lambda at: transition(low, at)))
    score = score + F.when(both, formula).otherwise(0.0)
    return score - F.when(norm_compare(a).isin(*GENERIC), 25.0).otherwise(0.0) - size * 0.03


def _find(text: Column, part: Column) -> Column:
    """1-based position of ``part``, 0 if absent."""
    return F.position(part, text)


def strict_support(option: Column, evidence: Column) -> Column:
    """The whole phrase occurs in the evidence; a single token must occur as a whole word."""
    return let(norm_evidence(option), lambda o: let(norm_evidence(evidence), lambda ev: supported_in(o, ev)))


def supported_in(o: Column, ev: Column) -> Column:
    """``strict_support`` on texts that are already normalized."""
    single = let(words(o), lambda w: (F.size(w) == 1) & F.array_contains(words(ev), F.get(w, 0)))
    return F.when((o == "") | (ev == ""), False).when(F.contains(ev, o), True).otherwise(single)


def loose_support(option: Column, answer: Column, evidence: Column) -> Column:
    """At least two content tokens and two thirds of them occur; a single one must occur."""
    o = norm_evidence(option)
    s = norm_evidence(F.concat(F.coalesce(answer, F.lit("")), F.lit(" "), F.coalesce(evidence, F.lit(""))))
    def check(o, s, tokens, hit):
        return (F.when((o == "") | (s == ""), False).when(F.contains(s, o), True).when(F.size(tokens) == 0, False)
                .when(F.size(tokens) == 1, hit == 1).otherwise((hit >= 2) & (hit / F.size(tokens) >= 0.67)))

    content = lambda o: F.filter(words(o), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP))
    hits = lambda s, tokens: let(words(s), lambda have: F.size(F.filter(tokens, lambda t: F.array_contains(have, t))))
    return let(o, lambda o: let(s, lambda s: let(content(o), lambda tokens: let(
        hits(s, tokens), lambda hit: check(o, s, tokens, hit)))))


def is_label_evidence(answer: Column, evidence: Column) -> Column:
    """The evidence has the form "answer: definition"."""
    ev = F.lower(strip(F.regexp_replace(squeeze(evidence), r"\A" + BULLET, "")))
    return let(F.lower(squeeze(answer)), lambda a: let(ev, lambda ev: (a != "") & (
        F.startswith(ev, F.concat(a, F.lit(":"))) | F.startswith(ev, F.concat(a, F.lit(" :"))))))


def is_clause(option: Column) -> Column:
    """An option that reads as a clause."""
    t = squeeze(option)
    return (t != "") & (starts_with_any(F.lower(t), CLAUSE_STARTS) | t.rlike(r"[.!?]\z"))


def is_label(option: Column) -> Column:
    """An option that reads as a term; rather too strict than too lax."""
    def check(t, n, padded):
        bad = F.arrays_overlap(F.transform(words(t), F.lower), one_of(LABEL_BAD_WORDS))
        return ((t != "") & word_count(t).between(1, 7) & ~t.rlike("[,;:!?]") & ~F.endswith(t, F.lit(".")) & (n != "")
                & ~starts_with_any(n, LABEL_BAD_STARTS) & ~has_any(padded, LABEL_BAD_INSIDE) & ~bad)

    return let(strip(F.regexp_replace(squeeze(option), r"\A" + BULLET, "")), lambda t: let(norm_compare(t), lambda n: let(
        F.concat(F.lit(" "), n, F.lit(" ")), lambda padded: check(t, n, padded))))


def formula_variants(answer: Column) -> Column:
    """Wrong formulas made by changing the first operator, and the swapped equation."""
    def variants(left, right):
        def changed(sign, others):
            head = F.rtrim(F.substring_index(right, sign, 1))
            tail = F.ltrim(F.substring(right, _find(right, F.lit(sign)) + 1, F.length(right)))
            return [F.concat(left, F.lit(" = "), head, F.lit(f" {o} "), tail) for o in others]

        swapped = F.concat(right, F.lit(" = "), left)
        return (F.when(left == "", F.array().cast("array<string>"))
                .when(F.contains(right, F.lit("+")), F.array(*changed("+", "-×/"), swapped))
                .when(F.contains(right, F.lit("-")), F.array(*changed("-", "+×/"), swapped))
                .otherwise(F.array(swapped)))

    return let(_text(answer), lambda a: let(F.regexp_extract(a, FORMULA_SHAPE, 1), lambda left: let(
        strip(F.regexp_extract(a, FORMULA_SHAPE, 2)), lambda right: variants(left, right))))


def pick_distractors(given: Column, answer: Column, evidence: Column, near: Column, pool: Column) -> Column:
    """Exactly three safe distractors, null if there are not enough.

    Given ones in order, then candidates of the context and of the section (at most 8 and 80) by label
    shape, words, length and text, then formula variants.
    """
    empty = F.array().cast("array<string>")

    def facts():
        raw = F.coalesce(answer, F.lit(""))
        return F.struct(F.contains(raw, F.lit("=")).alias("formula"), is_label_evidence(answer, evidence).alias("labelled"),
                        norm_compare(_text(answer)).alias("norm"), norm_evidence(evidence).alias("ev"))

    def ranked(f):
        texts = F.filter(F.transform(F.concat(F.coalesce(near, empty), F.coalesce(pool, empty)), _text), lambda x: x != "")
        keyed = F.transform(texts, lambda x, i: F.struct(
            F.when(~f.formula & f.labelled, F.when(is_label(x), 0).otherwise(1)).otherwise(0).alias("shape"),
            word_count(x).alias("words"), F.length(x).alias("size"), norm_compare(x).alias("norm"), i.alias("pos"), x.alias("text")))
        return F.transform(F.array_sort(keyed), lambda r: r.text)

    def safe(f, x, n):
        a = f.norm
        return ((x != "") & (F.contains(x, F.lit("=")) == f.formula) & (n != "") & (n != a)
                & ((a == "") | ~(F.contains(n, a) | F.contains(a, n)))
                & (f.formula | ~f.labelled | is_label(x)) & ~let(norm_evidence(x), lambda o: supported_in(o, f.ev)))

    def chosen(f):
        tidy = lambda x: strip(F.regexp_replace(squeeze(x), r"\A" + BULLET, ""))
        more = lambda acc, x, n: F.when(~F.array_contains(acc.norms, n) & safe(f, x, n), F.struct(
            F.array_append(acc.texts, x).alias("texts"), F.array_append(acc.norms, n).alias("norms"))).otherwise(acc)
        # Three are enough, so candidates stop being looked at once three are found, and are ranked only if they are asked for.
        taken = lambda start, raws: F.aggregate(raws, start, lambda acc, raw: F.when(F.size(acc.texts) >= 3, acc).otherwise(
            let(tidy(raw), lambda x: let(norm_compare(x), lambda n: more(acc, x, n)))))
        pick = let(taken(F.struct(empty.alias("texts"), empty.alias("norms")), F.coalesce(given, empty)), lambda acc: F.when(
            F.size(acc.texts) >= 3, acc).otherwise(taken(acc, F.concat(ranked(f), formula_variants(answer)))))
        return let(pick.texts, lambda three: F.when(F.size(three) == 3, three))

    return let(facts(), chosen)


def correct_key(slot: Column) -> Column:
    """Position of the right option by slot id."""
    number = strip(slot).try_cast("long")
    codes = F.aggregate(F.filter(F.split(slot, ""), lambda x: x != ""), F.lit(0).cast("long"),
                        lambda s, x: s + F.ascii(x).cast("long"))
    return F.element_at(one_of(KEYS), (F.pmod(F.coalesce(number, codes), F.lit(4)) + 1).cast("int"))


def mask(answer: Column, evidence: Column) -> Column:
    """The first occurrence of the answer in the evidence replaced by a blank; null if absent."""
    def pattern(a):
        tokens = F.transform(F.split(a, SPACE + "+"), literal_pattern)
        return F.concat(F.lit("(?ius)\\A(.*?)"), F.array_join(tokens, SPACE + "+"), F.lit("(.*)\\z"))

    def cut(ev, p):
        group = lambda n: F.call_function("regexp_extract", ev, p, F.lit(n))
        return F.when(F.rlike(ev, p), F.concat(group(1), F.lit(BLANK), group(2)))

    return let(_text(answer), lambda a: let(_text(evidence), lambda ev: F.when(
        (a != "") & (ev != ""), let(pattern(a), lambda p: cut(ev, p)))))


def cloze_window(masked: Column, size: int = 190) -> Column:
    """At most ``size`` characters around the blank, cut at words."""
    hole = len(BLANK)

    def open_left(part, left):
        space = F.instr(part, " ")
        before = (space > 0) & ((F.instr(part, BLANK) == 0) | (F.instr(part, BLANK) + hole - 1 > space - 1))
        rest = F.when(before, F.ltrim(F.substring(part, space + 1, F.length(part)))).otherwise(part)
        return F.when(left > 1, F.concat(F.lit("… "), rest)).otherwise(part)

    def open_right(part, more):
        last = F.length(part) - F.instr(F.reverse(part), " ") + 1
        shorter = F.when((F.instr(part, " ") > 0) & (last > 1), F.rtrim(F.substring(part, F.lit(1), last - 1))).otherwise(part)
        return F.when(more, F.concat(shorter, F.lit(" …"))).otherwise(part)

    def cut(t):
        left = F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), F.instr(t, BLANK) - size // 2), F.length(t) - size + 1))
        return let(left, lambda at: let(open_left(strip(F.substring(t, at, F.lit(size))), at), lambda part: open_right(
            part, at + size - 1 < F.length(t))))

    return let(squeeze(masked), lambda t: F.when((F.instr(t, BLANK) == 0) | (F.length(t) <= size), t).otherwise(cut(t)))


def cloze_stem(answer: Column, evidence: Column) -> Column:
    """Fill-in stem made of the evidence; null if the answer cannot stand alone or does not occur."""
    def plain(window):
        c = F.regexp_replace(window, f"\\A({SPACE}*…{SPACE}*)(?:[•●▪◦]+|[-*]+){SPACE}*", "$1")
        return strip(F.regexp_replace(c, r"\A" + BULLET, ""))

    formula, english = F.contains(_text(answer), F.lit("=")), lang_hint(evidence) == "EN"
    prefix = (F.when(formula, F.when(english, CLOZE_PREFIX["formula", "EN"]).otherwise(CLOZE_PREFIX["formula", "VI"]))
              .otherwise(F.when(english, CLOZE_PREFIX["term", "EN"]).otherwise(CLOZE_PREFIX["term", "VI"])))
    return F.when(standalone_issue(answer).isNull(), let(mask(answer, evidence), lambda m: F.when(m.isNotNull(), let(
        plain(cloze_window(m)), lambda body: F.when(body != "", F.concat(prefix, body))))))


def repair_high_risk(stem: Column, answer: Column, evidence: Column) -> Column:
    """Cloze stem for PURPOSE, REQUIREMENT, CAUSE and EFFECT stems; null if not needed or still high-risk."""
    return F.when(relation(stem).isin(*HIGH_RISK), let(cloze_stem(answer, evidence), lambda c: F.when(
        c.isNotNull() & ~relation(c).isin(*HIGH_RISK), c)))


def normalize_formula(option: Column) -> Column:
    """Lead-in words before a formula removed."""
    tail = lambda x: strip(strip(F.substring(x, _find(x, F.lit("=")) + 1, F.length(x))), EDGE)
    alone = lambda t: let(equations(t), lambda eq: F.when(
        (F.size(eq) == 1) & (tail(t) == tail(F.get(eq, 0))), F.get(eq, 0)).otherwise(t))
    lead = lambda t: let(strip(F.regexp_replace(t, FORMULA_LEAD, "")), lambda bare: F.when(
        (bare != "") & F.contains(bare, F.lit("=")) & (bare != t), strip(bare, EDGE)).otherwise(alone(t)))
    return let(squeeze(option), lambda t: F.when(F.contains(t, F.lit("=")), lead(t)).otherwise(t))


def rewrite_needs_context(stem: Column, formula: Column, evidence: Column) -> Column:
    """A "what does it become" stem without a formula while the evidence has several for the symbol."""
    several = lambda left: (left != "") & (F.size(F.filter(equations(evidence), lambda e: lhs(e) == left)) >= 2)
    return let(_text(stem), lambda s: (s != "") & ~F.contains(s, F.lit(BLANK)) & has_any(norm_compare(s), REWRITE_QUESTIONS)
               & let(lhs(formula), several) & (F.size(equations(s)) == 0))


def right_option(options: Column) -> Column:
    return _text(F.get(F.filter(options, lambda o: o.is_correct), 0).getField("option_text"))


def fit_issue(stem: Column, options: Column, evidence: Column) -> Column:
    """First reason why question and answer do not fit; null if they do."""
    one = F.size(F.filter(options, lambda o: o.is_correct)) == 1
    facts = let(right_option(options), lambda answer: F.struct(
        answer.alias("answer"), norm_compare(_text(stem)).alias("q"), norm_compare(answer).alias("a"),
        standalone_issue(answer).alias("alone"), lang_hint(evidence).alias("source"), lang_hint(stem).alias("asked")))
    return F.when(~one, "question must contain exactly one correct option").otherwise(
        let(facts, lambda f: _fit(f, options, evidence)))


def _fit(f: Column, options: Column, evidence: Column) -> Column:
    same = let(lhs(f.answer), lambda left: F.size(F.filter(equations(evidence), lambda e: (left != "") & (lhs(e) == left))))
    formula_q = has_any(f.q, FORMULA_QUESTIONS)
    known = f.source.isin("VI", "EN")
    other = F.exists(options, lambda o: (_text(o.option_text) != "") & ~F.contains(o.option_text, F.lit("="))
                     & lang_hint(o.option_text).isin("VI", "EN") & (lang_hint(o.option_text) != f.source))
    return (F.when((f.q == "") | (f.a == ""), "question/correct answer cannot be empty")
            .when((F.length(f.a) >= 3) & F.contains(f.q, f.a), "question stem contains the correct answer verbatim")
            .when(has_any(f.q, LIST_QUESTIONS) & ~has_any(f.answer, LIST_ANSWERS),
                  "list-style question has a non-list correct answer")
            .when(formula_q & ~F.contains(f.answer, F.lit("=")), "formula-style question has a non-formula correct answer")
            .when(formula_q & ~has_any(f.q, FORMULA_CONTEXT) & (same >= 2),
                  "formula question is ambiguous because evidence contains multiple formulas for the same symbol")
            .when(f.alone.isNotNull(), F.concat(F.lit("correct answer is not standalone: "), f.alone))
            .when(has_any(f.q, ROLE_QUESTIONS) & (word_count(f.answer) <= 2) & ~has_any(f.a, ROLE_ANSWERS),
                  "role/function question has an overly short nominal answer")
            .when(has_any(f.q, TIME_QUESTIONS) & f.a.isin(*TIME_BAD_ANSWERS), "time question has a deictic non-standalone answer")
            .when(known & f.asked.isin("VI", "EN") & (f.source != f.asked), F.concat(
                F.lit("question language does not match evidence language ("), f.asked, F.lit("!="), f.source, F.lit(")")))
            .when(known & other, "option language does not match evidence language"))


def grounding_verdict(source: Column, stem: Column, options: Column, evidence: Column) -> Column:
    """N27: "OK", or the first reason why the evidence does not carry the question."""
    def last(ev, n):
        wrong = F.transform(F.filter(options, lambda o: ~o.is_correct & let(
            norm_evidence(o.option_text), lambda x: supported_in(x, n))), lambda o: F.concat(F.lit("'"), o.option_key, F.lit("'")))
        return let(wrong, lambda w: F.when(
            ~let(norm_evidence(right_option(options)), lambda x: supported_in(x, n)),
            "fast gate correct option lacks direct support in evidence")
            .when(F.size(w) > 0, F.concat(F.lit("fast gate found distractor(s) also directly supported by evidence: ["),
                                          F.array_join(w, ", "), F.lit("]"))).otherwise("OK"))

    def check(ev, n, kind):
        return (F.when(ev == "", "fast gate missing evidence_quote")
                .when(F.length(ev) > MAX_EVIDENCE, "fast gate evidence_quote is too long")
                .when((F.length(n) < MIN_EVIDENCE) | ~F.contains(norm_evidence(source), n),
                      "fast gate evidence quote does not exist verbatim in SOURCE")
                .when(~relation_in_evidence(kind, ev), F.concat(
                    F.lit("fast gate evidence does not contain the required semantic relation "), kind))
                .otherwise(let(fit_issue(stem, options, ev), lambda issue: F.when(
                    issue.isNotNull(), F.concat(F.lit("fast gate pedagogical fit failed: "), issue)).otherwise(last(ev, n)))))

    return let(_text(evidence), lambda ev: let(norm_evidence(ev), lambda n: let(relation(stem), lambda kind: check(ev, n, kind))))


def is_deterministic_failure(reason: Column) -> Column:
    """Failures that another model call would not cure."""
    return has_any(F.lower(F.coalesce(reason, F.lit(""))), DETERMINISTIC)
