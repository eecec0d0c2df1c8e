"""Plans that must not depend on how well a table is compressed."""

import os
import time

import pyarrow as pa
from pyspark.sql import functions as F
import pytest

import __spark_entry__ as entry
from studyloom.llm.common import slices, stored
from studyloom.operators.chunking import assign_sections
from studyloom.operators.items import assemble_questions, distractor_terms
from studyloom.session import SWEEP, cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables that are small as files and large as rows."""
    path = tmp_path_factory.mktemp("large")
    spark.range(40_000).selectExpr("id as p_partkey", "repeat('long name ', 12) as p_name", "'B' as p_brand", "'T' as p_type", "cast(id % 50 as int) as p_size",
                                    "1.0D as p_retailprice").coalesce(1).write.parquet(f"{path}/part.parquet")
    at = "timestamp_ntz'2000-01-01 10:00:00'"
    spark.range(40_000).selectExpr("id as o_orderkey", "id % 50 as o_custkey", "if(id % 2 = 0, 'P', 'F') as o_orderstatus", "1.0D as o_totalprice", f"{at} as o_orderdate",
                                   "'1' as o_orderpriority").coalesce(1).write.parquet(f"{path}/orders.parquet")
    spark.range(30_000).selectExpr("id as event_id", f"{at} as ts", "id % 50 as user_id", "if(id % 2 = 0, 'view', 'click') as event_type", "1.0D as value",
                                   "'{}' as props").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def shipped(plan):
    """What stands under the broadcasts of a plan."""
    lines = plan.split("Initial Plan")[0].split("\n")
    start = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if start[j] <= start[i]), len(lines))
            yield " ".join(lines[i:end])


@pytest.mark.parametrize("name", ["forked_options", "attempt_sheet"])
def test_options_are_not_shipped(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and not any("Generate explode" in x for x in shipped(plan))


def test_tasks_of_scores_do_not_grow_with_the_table(spark, folder):
    """Scores are grouped in tasks of a bounded size, however few partitions the session asks for."""
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, ("1", "false", "64KB")):
        spark.conf.set(k, v)
    try:
        entry.queries()["attempt_sheet"](spark, folder)
        own = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        before = spark.conf.get(own)
        spark.conf.set(own, "64KB")
        tasks = entry.queries()["attempt_sheet"](spark, folder).rdd.getNumPartitions()
        spark.conf.set(own, before)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert tasks > 1


def test_other_queries_keep_the_settings_of_the_session(spark):
    from studyloom.session import MEASURED, tune

    tune(spark)
    before = {k: spark.conf.get(k, None) for k in MEASURED}
    tune(tune(spark, measured=True), measured=True)
    assert {k: spark.conf.get(k) for k in MEASURED} == MEASURED
    tune(tune(spark))
    assert {k: spark.conf.get(k, None) for k in MEASURED} == before


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.startswith("shuffle_") for d in folders for _, _, files in os.walk(d) for f in files)


@pytest.mark.parametrize("write", [cut, stored])
def test_written_rows_leave_no_shuffle_behind(spark, write):
    before = shuffle_files(spark)
    rows = write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before and rows.count() == 7
    assert spark.conf.get(SWEEP, None) is None


def test_the_catalogue_of_answers_is_made_once(spark):
    """Answers of all texts cost most of an item; naming one of them must not make them again."""
    answers = spark.range(7).selectExpr("id as request_id", "'0' as slot", "concat('A', id % 2) as answer_id", "'E0' as evidence_id", "concat('term ', id) as answer")
    items = spark.range(5).selectExpr("id as request_id", "'0' as slot", "cast(null as string) as reason", "'Which term is meant?' as q", "'E0' as evidence_ids",
                                      "concat('We call it term ', id) as evidence", "'A0' as a", "cast(null as string) as c", "array('x ray', 'y ray', 'z ray') as d", "cast(null as array<string>) as o")
    made = assemble_questions(items, answers)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 7") == 1
    rows = {r["request_id"]: r for r in made.collect()}
    assert [rows[i]["reason"] for i in range(5)] == [None, "invalid answer id"] * 2 + [None]
    assert {o["option_text"] for o in rows[2]["options"]} == {"term 2", "x ray", "y ray", "z ray"}


def test_terms_are_normalized_once(spark):
    """Candidates are in normal form but for their case, so terms and spans need no further pattern; texts are only lower-cased."""
    chunks = spark.createDataFrame([(1, 1, 0, "First term, SECOND term; - third term!\tNext  one. 3. Not alone"), (1, 1, 1, "second TERM, “Quoted” here")],
                                   "section_id int, document_id int, chunk_index int, content string")
    made = distractor_terms(chunks)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert r"[.!?;,:\-]+\z" not in plan
    assert [r["text"] for r in made.orderBy("_at").collect()] == ["First term", "SECOND term", "third term", "Next one", "Not alone", "Quoted", "“Quoted” here"]


def test_words_of_a_block_are_bound_once(spark):
    """Titles are looked up among the outline's words of a block, not among all its words again for every word of a title."""
    blocks_df = spark.createDataFrame([(1, 0, "Chapter 1 alpha beta", "alpha beta and gamma delta"), (1, 1, "Chapter 2", "gamma delta"), (1, 2, None, "alpha")],
                                      "document_id int, block_index int, heading string, content string")
    sections = spark.createDataFrame([(7, 1, "Alpha beta", 1), (8, 1, "Gamma delta", 2)], "id int, document_id int, title string, section_order int")
    made = assign_sections(blocks_df, sections)
    assert "array_intersect" in made._jdf.queryExecution().optimizedPlan().toString()
    assert [r["section_id"] for r in made.orderBy("block_index").collect()] == [7, 8, None]


def test_tasks_take_texts_in_slices():
    """What a task holds of a batch is bounded by bytes of text; no row is lost, and a text larger than a slice stands alone."""
    texts = ["a" * 30, None, "b" * 50, "", "c" * 500, "d" * 60, "e" * 60]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": pa.array(texts)}), pa.RecordBatch.from_pydict({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})]
    got = [b.column("text").to_pylist() for b in slices(iter(batches), 100)]
    assert [t for part in got for t in part] == texts
    assert got == [texts[:4], [texts[4]], [texts[5]], [texts[6]]]
