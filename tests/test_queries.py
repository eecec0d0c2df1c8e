"""Registered queries against their SQL on the smallest data; a sample per module keeps the run short."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, duck

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["topic_performance", "attempt_scores", "subject_progress", "review_progress", "spaced_plan", "study_plan_tasks", "badges_earned",
          "usable_chunks", "quiz_view", "structural_issues", "same_id_sets", "normal_forms", "answer_checks", "structural_blocks", "sized_chunks",
          "vector_search", "text_search", "question_slots", "resolved_slots", "recovered_items"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 120


def test_cloze_quiz_invariants(spark):
    from studyloom.functions.text import norm_compare  # noqa: F401  (documents which form makes options distinct)

    rows = entry.queries()["cloze_quiz"](spark, FOLDER).collect()
    assert rows
    for r in rows:
        assert [o.option_key for o in r.options] == list("ABCD") and sum(o.is_correct for o in r.options) == 1
        assert len({o.option_text.lower() for o in r.options}) == 4 and "_____" in r.question_text
        assert next(o for o in r.options if o.is_correct).option_text == r.answer
