"""Exploded rows are never shipped on an estimate: Spark sizes them as if a row gave one."""

import pytest
from pyspark.sql import functions as F

from studyloom.llm import kneser_ney, overlap, simhash
from test_size import shipped


@pytest.fixture
def limit(spark):
    """Tables that look smaller than 10 MB are shipped, as in a session that says nothing."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shipped_after(links):
    """Links as a set, and what was shipped for them."""
    found = {(r["u"], r["v"]) for r in links.collect()}
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan
    return found, [x for x in shipped(plan) if "Generate" in x]


def test_block_keys_of_fingerprints_are_not_shipped(spark, limit):
    far = spark.range(2000).select(F.xxhash64("id").alias("fingerprint"))
    near = spark.createDataFrame([(0,), (1,), (3,), (7 << 50,)], "fingerprint long")
    prints = far.union(near).groupBy("fingerprint").agg(F.count("*").alias("first"))
    found, sent = shipped_after(simhash.link_fingerprints(prints))
    assert not sent
    assert {(1, 0), (3, 0), (7 << 50, 0)} <= found


def test_band_keys_of_entries_are_not_shipped(spark, limit):
    rows = spark.range(2000).select(F.col("id").alias("fingerprint"), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda n: F.when((n == 7) & (F.col("id") < 3), F.lit(-1)).otherwise(F.xxhash64("id", n))).alias("keys"))
    prints = rows.groupBy("fingerprint").agg(F.first("keys").alias("keys"))
    found, sent = shipped_after(overlap.band_links(prints))
    assert not sent
    assert found == {(1, 0), (2, 0)}


def test_model_tables_that_grow_are_not_shipped(spark, limit, monkeypatch):
    """Tables of three bytes and more are joined where they are, however small their files; every order is counted once, in a plan of its own."""
    made, write = [], kneser_ney.stored
    monkeypatch.setattr(kneser_ney, "stored", lambda df: made.append(df) or write(df))
    counts = spark.range(500).select(F.lit("en").alias("lang"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("gram"), F.lit(1).cast("long").alias("n"))
    grams, _ = kneser_ney.tables(write(counts), 5)
    tables = [df for df in made if df.columns == ["lang", "size", "gram", "p"]]
    assert len(tables) == 5
    for k, df in enumerate(tables, 1):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert k <= 2 or plan.count("BroadcastHashJoin") == 2, k  # the discounts, one row a language, for the grams and their contexts
        assert plan.count("HashAggregate") <= 6
    assert grams.where("size = 5").count() == 500
