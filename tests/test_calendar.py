"""The calendar of a plan counts every day of a scope in one pass over the topics."""

import datetime as dt
import re

from pyspark.sql import functions as F

from studyloom.operators import planning
from studyloom.plans.learning_queries import topics
from studyloom.plans.views import Learning


def as_of():
    return F.lit("2002-01-01 12:00:00").cast("timestamp_ntz")


SCHEMA = "user_id long, subject_id long, section_id long, status string, mastery_score double, attempts long, last_practiced_at timestamp_ntz"


def at(day, hour=9):
    return dt.datetime(2001, 12, 1, hour) + dt.timedelta(days=day)


def test_days_of_a_calendar(spark):
    rows = [(1, 1, 1, "WEAK", 10.0, 3, at(31)),  # a day after: on the second day
            (1, 1, 2, "WEAK", 10.0, 3, at(31)),
            (1, 1, 2, "WEAK", 10.0, 3, at(31)),  # a repeated row counts twice
            (1, 1, 3, "NOT_ENOUGH_DATA", 0.0, 0, None),  # never practised: today
            (1, 1, 4, "STRONG", 99.0, 9, at(0)),  # overdue: today
            (1, 1, 5, "STRONG", 99.0, 9, at(31)),  # beyond the horizon
            (2, 1, 1, "STRONG", 99.0, 9, at(31)),  # nothing within the horizon: empty days
            (None, 1, 1, "WEAK", 10.0, 3, at(31)), (3, None, 1, "WEAK", 10.0, 3, at(31))]  # no user or no subject: days without items
    df = spark.createDataFrame(rows, SCHEMA)
    made = planning.plan_calendar(df, as_of(), 3)
    assert made.columns == ["user_id", "subject_id", "scheduled_date", "item_count"]
    days = [dt.date(2002, 1, 1) + dt.timedelta(days=n) for n in range(3)]
    empty = [(u, s, d, 0) for u, s in ((2, 1), (None, 1), (3, None)) for d in days]
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + (r[2],)
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted([(1, 1, days[0], 2), (1, 1, days[1], 3), (1, 1, days[2], 0), *empty], key=key)
    assert planning.plan_calendar(df, as_of()).count() == 4 * 7


def test_topics_of_a_calendar_are_made_once(spark):
    """Made twice, their joins and groupings write their shuffles twice."""
    df = spark.range(50).selectExpr("id % 5 as user_id", "id % 3 as subject_id", "id as section_id", "'WEAK' as status", "10.0D as mastery_score", "3L as attempts",
                                    "timestamp_ntz'2001-12-30 09:00:00' as last_practiced_at")
    made = planning.plan_calendar(df, as_of())
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 50") == 1
    assert len(re.findall(r"\bExchange\b", made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString())) == 1
    assert made.count() == 15 * 7


def test_scopes_do_not_wait_for_distinct_answers(spark, tmp_path):
    """Scopes are made distinct at the end, so answers are grouped for the mastery alone."""
    spark.range(40).selectExpr("id as doc_id", "cast(null as string) as text", "'en' as lang", "1L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(80).selectExpr("id as p_partkey", "'n' as p_name", "'B' as p_brand", "cast(1 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(300).selectExpr("id as o_orderkey", "id % 20 as o_custkey", "if(id % 2 = 0, 'F', 'P') as o_orderstatus", "timestamp_ntz'2001-12-30 09:00:00' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(600).selectExpr("id % 300 as l_orderkey", "id % 75 as l_partkey", "if(id % 3 = 0, 'N', 'R') as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = topics(Learning(spark, str(tmp_path)))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[l_orderkey", plan)) == 1
    assert sorted({(r["user_id"], r["subject_id"]) for r in made.collect()}) == [(0, 0), (1, 0)]
