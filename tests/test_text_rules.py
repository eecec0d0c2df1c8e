"""Text cases with known results."""

from pyspark.sql import functions as F
import pytest

from studyloom.functions import questions as qn, text as tx
from studyloom.operators import chunking as ck, contexts as cx, items as it, retrieval as rt

STORE = "3. Phương tiện cất trữ: Tiền được rút khỏi lưu thông và đi vào cất trữ."
MONEY = "Tiền tệ là một hàng hóa đặc biệt đóng vai trò vật ngang giá chung."
MOVE = "Khi đó, công thức W = c + v + m chuyển thành W = k + m."


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("heading,number", [("CHƯƠNG 4: CẠNH TRANH VÀ ĐỘC QUYỀN", 4), ("Chapter XIV", 14), ("PHẦN 2", None), (None, None)])
def test_chapter_number(value, heading, number):
    assert value(tx.chapter_no, heading) == number


@pytest.mark.parametrize("text,hint", [("Giá trị thặng dư được tạo ra trong sản xuất.", "VI"),
                                       ("What is the correct formula after substitution?", "EN"), ("abc", "UNKNOWN"), ("", "UNKNOWN")])
def test_language(value, text, hint):
    assert value(tx.lang_hint, text) == hint


def test_search_form(value):
    assert value(tx.norm_search, "Kinh tế KTTT định hướng XHCN — Straße") == "kinh te kinh te thi truong dinh huong xa hoi chu nghia strasse"


def test_evidence_spans(value):
    assert value(cx.evidence_array, STORE) == [STORE]
    assert len(value(cx.evidence_array, "Hàng hóa có giá trị sử dụng. Hàng hóa cũng có giá trị.")) == 2
    assert len(value(cx.evidence_array, "Đặc điểm: nội dung thứ nhất; nội dung thứ hai.")) == 1
    long = "từ " * 400
    spans = value(cx.evidence_array, long)
    assert all(len(s) <= 500 for s in spans)
    assert value(cx.evidence_array, "2020 was long ago.  It ended in 10 ") == ["2020 was long ago.", "It ended in 10"]
    assert value(cx.evidence_array, "x" * 1100) == ["x" * 500, "x" * 100]


def test_standalone_and_short_answers(value):
    assert value(qn.standalone_issue, "Khi đó") and value(qn.standalone_issue, "Do đó giá tăng") and not value(qn.standalone_issue, "Tiền tệ")
    assert value(qn.short_answer_issue, "Giá trị", "• Giá trị của hàng hóa biểu hiện một nội dung kinh tế nhất định.")
    assert value(qn.short_answer_issue, "Tiền tệ", MONEY) is None
    assert value(qn.short_answer_issue, "ab(c", "ab(c: x") is None


def test_clean_answer(value):
    assert value(qn.clean_answer, "▪ Cạnh tranh giữa các ngành") == "Cạnh tranh giữa các ngành"
    assert value(qn.clean_answer, "1.2) - Giá;") == "Giá"


def test_formula_candidates(value):
    text = "W = c + v + m chuyển thành W = k + m."
    found = value(qn.answer_candidates, text)
    assert "W = c + v + m" in found and "W = k + m" in found and not any("chuyển thành" in x for x in found)
    assert value(qn.candidate_score, "W = k + m", text) > value(qn.candidate_score, "W = c + v + m", text)
    assert value(qn.candidate_score, "W = k + m", text) == 40 + 15 + 45 + 35 - 0.27 - 0  # 3 words, short, formula after the marker


def test_candidates_of_label_and_complement(value):
    assert value(qn.answer_candidates, STORE)[0] == "Phương tiện cất trữ"
    assert "một hàng hóa đặc biệt đóng vai trò vật ngang giá chung" in value(qn.answer_candidates, MONEY)
    assert value(qn.answer_candidates, "mot hai ba bon nam sau bay tam chin muoi muoi-mot muoi-hai muoi-ba muoi-bon") == [
        "mot hai ba bon nam sau bay tam chin muoi"]
    assert value(qn.answer_candidates, "") == []


def test_support(value):
    assert value(qn.strict_support, "Phương tiện lưu thông", STORE) is False
    assert value(qn.strict_support, "Phương tiện cất trữ", STORE) is True
    assert value(qn.strict_support, "(trữ)", STORE) is True
    assert value(qn.loose_support, "tiền lưu thông xa", "", STORE) is True
    assert value(qn.loose_support, "tiền xa lạ", "", STORE) is False


def test_label_shapes(value):
    assert value(qn.is_label, "Giá trị thặng dư") and value(qn.is_label, "Tư bản khả biến")
    assert not value(qn.is_label, "cộng với chi phí đào tạo") and not value(qn.is_label, "Là nơi lưu trữ giá trị")
    assert value(qn.is_clause, "Là nơi lưu trữ giá trị") and not value(qn.is_clause, "Tư bản")
    assert value(qn.is_label_evidence, "Giá trị sử dụng", "• Giá trị sử dụng : công dụng")


def test_distractors(value):
    ev = "• Cạnh tranh giữa các ngành: Sự cạnh tranh giữa các ngành khác nhau."
    near = ["Cạnh tranh giữa các ngành", "Lợi nhuận bình quân"]
    three = value(qn.pick_distractors, ["các ngành khác nhau", "Độc quyền", "Tích tụ tư bản"], "Cạnh tranh giữa các ngành", ev, near, [])
    assert three == ["Độc quyền", "Tích tụ tư bản", "Lợi nhuận bình quân"]
    formulas = value(qn.pick_distractors, ["a", "b", "W = k + m"], "W = k + m", MOVE, [], [])
    assert formulas == ["W = k - m", "W = k × m", "W = k / m"]
    assert value(qn.pick_distractors, [], "Tiền", MONEY, ["Tiền tệ"], ["vàng"]) is None
    ranked = value(qn.pick_distractors, [], "Tư bản bất biến", "Tư bản bất biến không đổi.", ["hai từ", "một"], ["ba từ dài", "Một."])
    assert ranked == ["một", "hai từ", "ba từ dài"]


def test_cloze(value):
    assert value(qn.mask, "W = k + m", MOVE) == "Khi đó, công thức W = c + v + m chuyển thành _____."
    assert value(qn.cloze_stem, "W  = k + m", MOVE) == \
        "Điền công thức thích hợp vào chỗ trống: Khi đó, công thức W = c + v + m chuyển thành _____."
    assert value(qn.relation, "Điền cụm từ thích hợp vào chỗ trống: Mục đích của lưu thông hàng hóa là _____.") == "FACT"
    assert value(qn.relation, "Mục đích của lưu thông là gì?") == "PURPOSE"
    long = "đầu " * 60 + "_____ " + "cuối " * 60
    window = value(qn.cloze_window, long)
    assert window.startswith("… ") and window.endswith(" …") and "_____" in window and len(window) <= 194
    assert value(qn.cloze_stem, "khi đó", MOVE) is None and value(qn.cloze_stem, "vắng mặt", MOVE) is None


def test_formula_cleanup(value):
    assert value(qn.normalize_formula, "trong đó T' = T + ΔT") == "T' = T + ΔT"
    assert value(qn.normalize_formula, "khi đó W = k + m.") == "W = k + m"
    assert value(qn.normalize_formula, "không có") == "không có"
    assert value(qn.rewrite_needs_context, "Công thức W được viết lại thành gì?", "W = k + m", MOVE) is True
    assert value(qn.repair_high_risk, "Mục đích là gì?", "vật ngang giá chung", MONEY).startswith("Điền cụm từ")


def options(spark, texts, right=0):
    return F.array(*[F.struct(F.lit("ABCD"[i]).alias("option_key"), F.lit(x).alias("option_text"), F.lit(i == right).alias("is_correct"))
                     for i, x in enumerate(texts)])


def test_fit(spark):
    one = spark.range(1)
    fit = lambda q, t, e: one.select(qn.fit_issue(F.lit(q), options(spark, t), F.lit(e)).alias("v")).first().v
    assert fit("Giá trị gồm những yếu tố nào?", ["Giá trị", "a", "b", "c"], MONEY) == "question stem contains the correct answer verbatim"
    assert fit("What is the value of the money?", ["vật ngang giá chung", "a", "b", "c"], MONEY).startswith("question language does not match")
    assert fit("Nêu công thức của giá trị hàng hóa", ["tiền tệ", "a", "b", "c"], MONEY).startswith("formula-style")
    assert fit("Công thức của W trong sản xuất là gì?", ["W = k + m", "a", "b", "c"], MOVE).startswith("formula question is ambiguous")
    verdict = lambda s, q, t, e: one.select(qn.grounding_verdict(F.lit(s), F.lit(q), options(spark, t), F.lit(e)).alias("v")).first().v
    assert verdict(MONEY, "Tiền tệ đóng vai trò nào trong lưu thông?", ["vật ngang giá chung", "Độc quyền", "Tích tụ", "Lợi nhuận"], MONEY) == "OK"
    assert verdict("khác", "Tiền tệ là gì?", ["vật ngang giá chung", "b", "c", "d"], MONEY).endswith("verbatim in SOURCE")
    assert "['B']" in verdict(MONEY, "Tiền tệ đóng vai trò nào?", ["vật ngang giá chung", "hàng hóa đặc biệt", "Tích tụ", "Lợi nhuận"], MONEY)


BOOK = "Lời nói đầu ngắn.\n" + "".join(
    f"CHƯƠNG {n}\n{title}\n" + f"{title} được trình bày ở đây trong nhiều câu. " * 6 + "\n"
    for n, title in ((3, "Giá trị thặng dư và tư bản"), (4, "Cạnh tranh và kinh tế thị trường"), (5, "Kinh tế thị trường định hướng XHCN")))
SECTIONS = [(1, 1, "Hàng hóa và tiền tệ", 1), (2, 1, "Giá trị thặng dư và tư bản", 2), (4, 1, "Cạnh tranh và kinh tế thị trường", 3),
            (3, 1, "Kinh tế thị trường định hướng XHCN", 4)]


def test_structural_chunks(spark):
    docs = spark.createDataFrame([(1, BOOK)], "document_id long, content string")
    sections = spark.createDataFrame(SECTIONS, "id long, document_id long, title string, section_order int")
    out = ck.chunk_documents(docs, sections, 180, 40).orderBy("chunk_index").collect()
    blocks = [F_json(r.metadata) for r in out]
    assert 0 not in {b["structural_block_index"] for b in blocks}
    assert {(b["structural_block_index"], r.section_id) for b, r in zip(blocks, out)} == {(1, 2), (2, 4), (3, 3)}
    assert all(r.content.count("CHƯƠNG") <= 1 and len(r.content) <= 180 for r in out)
    assert [r.chunk_index for r in out] == list(range(len(out)))
    assert blocks[0]["structural_heading"].startswith("CHƯƠNG 3")


def F_json(text):
    import json

    return json.loads(text)


def test_learning_filter(spark):
    short = "".join(f"CHƯƠNG {n}: Tên {n}\nmục ngắn\n" for n in range(1, 6))
    full = "".join(f"CHƯƠNG {n}: Tên {n}\n" + "nội dung dài của chương. " * 40 + "\n" for n in range(1, 6))
    docs = spark.createDataFrame([(7, "TRANG BÌA\n" + short + full)], "document_id long, content string")
    out = ck.skip_reasons(ck.blocks(docs)).filter("skip_reason is not null")
    assert {r.block_index for r in out.collect()} == {0, 1, 2, 3, 4, 5}


def test_blocks_keep_offsets(spark):
    docs = spark.createDataFrame([(1, "  \n" + BOOK)], "document_id long, content string")
    text = BOOK.strip()
    for r in ck.blocks(docs).collect():
        assert text[r.char_start:r.char_end].strip() == r.content


def brute_chunks(text, size, overlap):
    """Sizing by direct search over every position: slow and plain."""
    import re

    overlap, out, start = min(overlap, size // 2), [], 0
    while start < len(text):
        hard = min(len(text), start + size)
        end = len(text)
        if hard < len(text):
            low = min(hard, start + max(1, int(size * .62)))
            ends = [low + m.end() for p in (r"\n", r"(?<=[.!?;])\s+") for m in re.finditer(p, text[low:hard])]
            blanks = [i for i in range(low, hard) if text[i] == " "]
            end = max(ends) if ends else (blanks[-1] if blanks and blanks[-1] > start else hard)
        if text[start:end].strip():
            out.append((start, end, text[start:end].strip()))
        if end >= len(text):
            return out
        nxt = max(start + 1, end - overlap)
        while 0 < nxt < end and not text[nxt - 1].isspace() and not text[nxt].isspace():
            nxt += 1
        while nxt < end and text[nxt].isspace():
            nxt += 1
        start = end if nxt <= start else min(nxt, end)
    return out


def test_sizing_against_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("abcdef.;!?  \n\n") for _ in range(rng.randint(0, 300))).strip()
        size = rng.randint(1, 80)
        overlap = rng.randint(0, 60)
        assert ck.size_chunks(text, size, overlap) == brute_chunks(text, size, overlap), (text, size, overlap)


def test_chunker_in_sql(spark):
    ck.register_chunker(spark)
    out = spark.sql("select * from study_chunks('một hai ba bốn năm sáu bảy', 12, 4)").collect()
    assert [(r.start, r.end, r.content) for r in out] == brute_chunks("một hai ba bốn năm sáu bảy", 12, 4)


def test_context_windows(spark, value):
    text = "3. Phương tiện cất trữ: " + "nội dung rất dài, " * 40 + ". Câu sau. " + "x" * 600
    units = value(cx.context_units, text)
    assert "3." not in units and any(u.startswith("3. Phương tiện cất trữ:") for u in units) and all(len(u) <= 520 for u in units)
    df = spark.createDataFrame([(1, "\n\n".join(c * 150 for c in "ABCA")), (2, ""), (3, "ab"), (4, " ".join("y" * 100 for _ in range(9)))], "chunk_id long, text string")
    rows = cx.micro_contexts(df).collect()
    assert [(w.start_unit, w.end_unit) for w in rows if w.chunk_id == 1] == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3)]
    assert [w.text for w in rows if w.chunk_id == 3] == ["ab"] and not [w for w in rows if w.chunk_id == 2]
    assert [len(w.text) for w in rows if w.chunk_id == 4] == [504, 403]
    assert value(cx.context_units, "One two. " * 100)[0] == " ".join(["One two."] * 57)


def test_packed_paragraphs(spark):
    text = "aa\n\nbb\n \ncc\n\n" + "x" * 25 + "\n\ndd\n\nee"
    df = spark.createDataFrame([(1, text), (2, None), (3, "  ")], "document_id long, content string")
    rows = sorted((r.document_id, r.chunk_index, r.content) for r in ck.pack_paragraphs(df, 10, 3).collect())
    assert rows == [(1, 0, "aa\n\nbb\n\ncc"), (1, 1, "x" * 10), (1, 2, "x" * 10), (1, 3, "x" * 10), (1, 4, "x" * 4), (1, 5, "dd\n\nee")]


def test_questions_with_backslashes(spark):
    docs = spark.createDataFrame([(1, 7, 1, "READY")], "id long, owner_id long, subject_id long, status string")
    chunks = spark.createDataFrame([(1, 1, True, "say a\\d b now"), (2, 1, True, "say ad b 100% now"), (3, 1, True, "a_d b \\")], "id long, document_id long, is_active boolean, content string")
    asked = {1: "a\\d b", 2: "harmless", 3: "100\\%", 4: "A\\_d", 5: "a_d", 6: "a\\\\d", 7: "x" * 200 + "q"}
    q = spark.createDataFrame([(i, 7, t) for i, t in asked.items()], "question_id long, owner_id long, query string")
    got = {}
    for r in rt.substring_search(q, chunks, docs).collect():
        got.setdefault(r.question_id, set()).add(r.chunk_id)
    assert got == {1: {2}, 3: {2}, 4: {3}, 5: {1, 3}, 6: {1}}


def test_crop(spark):
    body = "x" * 200
    df = spark.createDataFrame([(f"{body}\nCHƯƠNG 2: sau",), (f"CHƯƠNG 1: a\n{body}\nCHƯƠNG 2: b",), ("ngắn\nCHƯƠNG 2: " + body,), (body,)], "t string")
    got = [tuple(r.c) for r in df.select(cx.crop_boundary(F.col("t")).alias("c")).collect()]
    assert [(g[0], g[1]) for g in got] == [(body, True), (f"CHƯƠNG 1: a\n{body}", True), ("ngắn\nCHƯƠNG 2: " + body, False), (body, False)]


def test_section_pools_do_not_mix(spark):
    df = spark.createDataFrame([(1, 1, 0, "Hàng hóa: vật phẩm. Giá trị: lao động."), (2, 1, 1, "Tư bản: tiền sinh lời."), (None, 1, 2, "Không: có.")],
                               "section_id long, document_id long, chunk_index int, content string")
    pools = {r.section_id: set(r.pool) for r in it.distractor_pool(df, 80).collect()}
    assert set(pools) == {1, 2} and "Hàng hóa" in pools[1] and "Tư bản" in pools[2] and not pools[1] & pools[2]


def test_recover_items(spark):
    body = '```json\n{"items":[{"q":"a}","n":1,} {"q":"b"} {"q":"c",}]}\n```'
    df = spark.createDataFrame([(1, body), (2, '{"items":[{"q":"x"},{"q":"y"}]}'), (3, "kein JSON"), (4, '{"items":[{"q":"z"},{"q":"open')],
                               "id long, content string")
    got = {}
    for r in it.recover_items(df).collect():
        got.setdefault(r.id, []).append(F_json(r["item"])["q"])
    assert got == {1: ["a}", "b", "c"], 2: ["x", "y"], 4: ["z"]}


def test_resolve_evidence(spark):
    e1 = "Tiền tệ là một hàng hóa đặc biệt trong lưu thông."
    cat = spark.createDataFrame([(1, "0", 0, "E0", "Câu đầu tiên của nguồn."), (1, "0", 1, "E1", e1)],
                                "request_id long, slot string, span_no int, evidence_id string, span string")
    asked = [" e1 ", e1.upper(), "một hàng hóa đặc biệt trong lưu", "Tiền là hàng hóa được diễn đạt lại khác", "", "Câu đầu tiên của nguồn. " + e1]
    rows_ = spark.createDataFrame([(1, "0", i, e, None) for i, e in enumerate(asked)], "request_id long, slot string, n int, e string, reason string")
    out = {r.n: (r.evidence_ids, r.reason) for r in it.resolve_evidence(rows_, cat).collect()}
    assert out == {0: ("E1", None), 1: ("E1", None), 2: ("E1", None), 3: (None, "invalid evidence reference"), 4: (None, "empty evidence"),
                   5: ("E0,E1", None)}


def test_evidence_of_many_spans(spark):
    """Runs against brute force where the evidence lies beyond the eighth span."""
    spans = [f'"Line {i} says word{i % 7}' + (" and more" if i % 3 else "") + '".' for i in range(30)]
    spans[12] = " \t"
    cat = spark.createDataFrame([(1, "0", i, f"E{i}", x) for i, x in enumerate(spans)], "request_id long, slot string, span_no int, evidence_id string, span string")
    asked = [spans[20], " ".join(spans[18:21]), spans[10] + " " + spans[11] + " " + spans[13], " ".join(spans[9:29])[9:-7], spans[25][9:] + " " + spans[26][:12], "x " * 20, "word4"]
    rows_ = spark.createDataFrame([(1, "0", i, e, None) for i, e in enumerate(asked)], "request_id long, slot string, n int, e string, reason string")
    norm = lambda x: " ".join(x.strip().lower().strip("\"“”'‘’").split())
    live = [i for i, x in enumerate(spans) if norm(x)]

    def wanted(e):
        runs = []
        for a in range(len(live)):
            for b in range(a, len(live)):
                text = norm(" ".join(spans[i] for i in live[a:b + 1]))
                if text == norm(e) or len(norm(e)) >= it.LITERAL_MIN and norm(e) in text:
                    runs.append((b - a, len(text), ",".join(f"E{i}" for i in live[a:b + 1])))
        best = [r for r in runs if r[:2] == min(runs)[:2]]
        return best[0][2] if len(best) == 1 else None

    out = {r.n: r.evidence_ids for r in it.resolve_evidence(rows_, cat).collect()}
    assert out == {i: wanted(e) for i, e in enumerate(asked)} and sum(x is not None for x in out.values()) == 5


def test_evidence_queries_read_every_line(spark, tmp_path):
    import __spark_entry__ as entry

    again = "A line that comes again, word for word."
    text = "\n".join(["A first line of this text here.", again, *[f"Line number {i} of the text." for i in range(9)], again])
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.evidence_ids for r in entry.queries()["resolved_evidence"](spark, str(tmp_path)).collect()] == [None]  # two lines are equal


def test_slots(spark):
    df = spark.createDataFrame([(1, i, "{}") for i in range(3)] + [(2, 0, '{"slot":0}'), (2, 1, "{}"), (3, 0, '{"slot_id":"0"}'), (4, 0, '{"slot":"0"}')],
                               "request_id long, position int, item string")
    slots = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (4, 7)], "request_id long, slot int")
    got = sorted((r.request_id, r.position, r.slot, r.reason) for r in it.resolve_slots(df, slots).collect())
    assert got == [(1, 0, "0", None), (1, 1, "1", None), (1, 2, "2", None), (2, 0, "0", None), (2, 1, "1", None), (3, 0, "0", None), (4, 0, "7", None)]


def test_assembly(spark):
    items_ = spark.createDataFrame(
        [(1, "2", None, "Chọn thuật ngữ đúng?", "A0", ["Độc quyền", "Tích tụ", "Lợi nhuận"], None, None, "E0", MONEY),
         (2, "0", None, "Hỏi gì?", None, None, "b", ["w", "x", "y", "z"], "E0", MONEY),
         (3, "0", None, "Hỏi?", "A9", ["a", "b", "c"], None, None, "E0", MONEY)],
        "request_id long, slot string, reason string, q string, a string, d array<string>, c string, o array<string>, evidence_ids string, evidence string")
    answers = spark.createDataFrame([(1, "2", "A0", "E0", "vật ngang giá chung")], "request_id long, slot string, answer_id string, evidence_id string, answer string")
    out = {r.request_id: r for r in it.assemble_questions(items_, answers).collect()}
    assert [o.option_text for o in out[1].options] == ["Độc quyền", "Tích tụ", "vật ngang giá chung", "Lợi nhuận"]
    assert [o.is_correct for o in out[1].options] == [False, False, True, False]
    assert [o.is_correct for o in out[2].options] == [False, True, False, False]
    assert out[3].reason == "invalid answer id"


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_texts_met_by_many_markers_are_computed_once(spark):
    x = spark.sql("select 'Wird UMGEFORMT: it is converted to W = 2' as x")
    for found in (tx.has_any(F.reverse("x"), ("a", "b")), tx.starts_with_any(F.reverse("x"), ("a", "b"))):
        assert "(reverse(x" in plan_of(x.select(found)) and "contains(reverse(" not in plan_of(x.select(found)) and "StartsWith(reverse(" not in plan_of(x.select(found))
    asked = x.select(qn.rewrite_needs_context(F.col("x"), F.reverse(F.lit("2 = W")), F.lit("W = 2 và W = 3")).alias("v"))
    assert plan_of(asked).count("reverse(2 = W)") <= 2


def test_candidates_of_distractors_are_ranked_once(spark):
    x = spark.sql("select array('Alpha', '  - beta ', 'alpha!', 'Gamma ray', 'Delta') as near")
    three = x.select(qn.pick_distractors(F.array(), F.lit("Omega"), F.lit("Omega is last"), F.reverse("near"), F.array()).alias("v"))
    assert plan_of(three).count("reverse(near") == 1
    assert three.first()["v"] == ["Alpha", "Delta", "beta"]


def test_marks_before_an_answer_go_in_one_pass(value):
    for text, want in (("- 1. * Wert ;", "Wert"), ("  a) b) Wert", "b) Wert"), ("•• 2.3. x", "x"), ("1.", ""), ("", ""), ("Wert - ", "Wert")):
        assert value(qn.clean_answer, text) == want
