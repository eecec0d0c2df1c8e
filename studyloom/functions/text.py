"""Column functions on text: whitespace, normal forms, language and chapter numbers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# The characters that count as white space, and the class of word characters.
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
               "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"
BULLET = SPACE + r"*(?:[•●▪◦]+|[-*]+)" + SPACE + "*"
NUMBERING = SPACE + r"*(?:\p{Nd}+(?:\.\p{Nd}+)*|[A-Za-z])[.)]" + SPACE + "*"


# Quotation marks that do not count at the ends of evidence.
QUOTES = "\"“”'‘’"

# ``SPACE`` for whole texts: letters fail at two comparisons instead of ten.
QUICK_SPACE = r"[\x00- \x85-\u3000&&" + SPACE + "]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column, chars: str = SPACE_CHARS) -> Column:
    return F.btrim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    """White space runs to one blank.  A lone blank is no match, so most texts are left as they are."""
    return F.regexp_replace(c, f"{QUICK_SPACE}(?:{QUICK_SPACE}+|(?<! ))", " ")


def squeeze(c: Column) -> Column:
    """White space runs to one blank, ends trimmed; null counts as empty."""
    return strip(collapse(F.coalesce(c, F.lit(""))))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD}+)"), 1)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{WORD}+"))


def one_of(values) -> Column:
    """A constant array of strings (none contains a bar), folded by the optimizer; one call whatever the length."""
    return F.split(F.lit("|".join(values)), r"\|")


def has_any(c: Column, markers) -> Column:
    """Does the text contain a marker?  It is computed once, not for every marker."""
    return let(c, lambda text: F.exists(one_of(markers), lambda m: F.contains(text, m)))


def starts_with_any(c: Column, prefixes) -> Column:
    return let(c, lambda text: F.exists(one_of(prefixes), lambda p: F.startswith(text, p)))


def literal_pattern(c: Column) -> Column:
    """A pattern that matches the column's text literally."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def clean_text(c: Column) -> Column:
    """NUL to blank, blank and tab runs to one blank, at most one empty line, ends trimmed."""
    c = F.regexp_replace(F.translate(c, "\x00", " "), "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def norm_compare(c: Column) -> Column:
    """N1."""
    return F.regexp_replace(collapse(F.lower(strip(c))), r"[.!?;,:\-]+\z", "")


def norm_evidence(c: Column) -> Column:
    """Lower case, outer quotes off, spaces collapsed, accents kept."""
    return collapse(strip(F.lower(strip(F.coalesce(c, F.lit("")))), QUOTES))


def front_key(c: Column) -> Column:
    """N4."""
    return collapse(F.lower(strip(F.coalesce(c, F.lit("")))))


def _plain_letters() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters whose unaccented, case-folded form is plain a-z0-9, by the Unicode decomposition rule."""
    one_from, one_to, many = [], [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn").casefold()
        if base and all(x in "abcdefghijklmnopqrstuvwxyz0123456789" for x in base):
            if len(base) == 1:
                one_from.append(ch)
                one_to.append(base)
            else:
                many.append((ch, base))
    return "".join(one_from), "".join(one_to), many


_FROM, _TO, _MANY = _plain_letters()

# Abbreviations that are spelled out before titles are compared.
ABBREVIATIONS = (("kttt", "kinh te thi truong"), ("xhcn", "xa hoi chu nghia"))


def norm_search(c: Column) -> Column:
    """Accents off, lower case, abbreviations spelled out, only a-z and 0-9 kept."""
    c = F.translate(F.coalesce(c, F.lit("")), "Đđ" + _FROM, "dd" + _TO)
    for ch, base in _MANY:
        c = F.replace(c, F.lit(ch), F.lit(base))
    c = F.lower(F.regexp_replace(c, r"\p{Mn}+", ""))
    for short, full in ABBREVIATIONS:
        c = F.regexp_replace(c, f"{NOT_AFTER_WORD}{short}{NOT_BEFORE_WORD}", full)
    return F.btrim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def chapter_no(heading: Column) -> Column:
    """Number of a chapter heading, digits or roman; null if there is none."""
    raw = F.upper(F.regexp_extract(
        F.coalesce(heading, F.lit("")),
        f"(?iu){NOT_AFTER_WORD}(?:CHƯƠNG|CHUONG|CHAPTER){SPACE}+(\\p{{Nd}}+|[IVXLCDM]+){NOT_BEFORE_WORD}", 1))
    values = F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items()
                            for x in kv])
    digits = F.filter(F.split(F.reverse(raw), ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("high"))

    def add(s, x):
        v = values[x]
        return F.when(v < s.high, F.struct((s.total - v).alias("total"), s.high.alias("high"))).otherwise(
            F.struct((s.total + v).alias("total"), v.alias("high")))

    roman = F.aggregate(digits, start, add, lambda s: s.total)
    return (F.when(raw.rlike(r"\A\p{Nd}+\z"), raw.try_cast("int"))
            .when(raw != "", F.nullif(roman, F.lit(0))))


# Letters and words that decide the language hint.
VI_LETTERS = ("ăâđêôơư" "áàảãạ" "ắằẳẵặ" "ấầẩẫậ" "éèẻẽẹ" "ếềểễệ" "íìỉĩị" "óòỏõọ" "ốồổỗộ" "ớờởỡợ" "úùủũụ" "ứừửữự" "ýỳỷỹỵ")
VI_WORDS = ("là", "của", "và", "trong", "được", "khi", "những", "các", "giá", "trị", "sản", "xuất", "hàng", "hóa", "cạnh",
            "tranh", "tư", "liệu", "lao", "động", "lợi", "nhuận", "tiền", "tệ", "thặng", "dư")
EN_WORDS = ("what", "which", "when", "where", "why", "how", "is", "are", "does", "do", "after", "before", "correct",
            "formula", "according", "source", "the", "of", "in", "production", "value", "competition")
LETTER = "[a-zA-ZÀ-ỹĐđ]"
LISTED_WORDS = f"(?<!{LETTER})({'|'.join(VI_WORDS + EN_WORDS)})(?!{LETTER})"


def lang_hint(c: Column) -> Column:
    """VI, EN or UNKNOWN; only clear cases are named."""
    def hits(found, listed):
        return F.size(F.array_intersect(found, one_of(listed)))

    def hint(low):
        letters = F.length(low) - F.length(F.translate(low, VI_LETTERS, ""))
        # One pass that returns listed words only.
        found = F.array_distinct(F.regexp_extract_all(low, F.lit(LISTED_WORDS), 1))
        by_words = F.transform(F.array(found), lambda f: F.when(hits(f, VI_WORDS) >= 2, "VI").when(
            (letters == 0) & (hits(f, VI_WORDS) == 0) & (hits(f, EN_WORDS) >= 2), "EN").otherwise("UNKNOWN"))
        return F.when(letters >= 2, "VI").otherwise(F.get(by_words, 0))

    return F.get(F.transform(F.array(F.lower(F.coalesce(c, F.lit("")))), hint), 0)


# Lower-case letters whose upper case is one letter alone, though it may also be written as several.
ONE_UPPER = {"ß": "ẞ"} | {chr(i): chr(i + 8) for first in (0x1F80, 0x1F90, 0x1FA0) for i in range(first, first + 8)} | {"ᾳ": "ᾼ", "ῃ": "ῌ", "ῳ": "ῼ"}


def upper_each(text: Column) -> Column:
    """Upper case character by character, as databases have it: no letter becomes several (ß stays one), so nothing is lost on the way back."""
    single = F.translate(text, "".join(ONE_UPPER), "".join(ONE_UPPER.values()))
    kept = F.transform(F.split(single, ""), lambda c: F.when((F.length(F.upper(c)) == 1) & ~c.isin(*ONE_UPPER.values()), F.upper(c)).otherwise(c))
    return F.array_join(kept, "")
