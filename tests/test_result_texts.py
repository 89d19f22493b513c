"""Texts of results: joined last, and to the rows that need them only."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark import registry
from quillspark.operators import results as R
from quillspark.session import shared_path
from quillspark.sources import fixtures as fx
from quillspark.sources.tables import Tables
from tests.conftest import SF_SMALL


def _joins(df):
    """The joins of the optimized plan, parents before children."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return [re.sub(r"#\d+L?", "", x) for x in lines if "Join " in x]


def _first(joins, pattern):
    return next(i for i, x in enumerate(joins) if re.search(pattern, x))


@pytest.fixture(scope="module")
def odd(spark):
    """Tables with ids that come twice, null ids, and results without a document or run."""
    base = shared_path(spark, "test", "odd_results")
    ev = [(i, "click", i % 4, f"2024-01-{10 + i % 12} 0{i % 3}:00:00") for i in [*range(24), 3, 3, 8]] + [(None, "view", 1, None), (25, "view", None, None)]
    for name, rows, schema in (
            ("events", ev, "event_id long, event_type string, user_id long, ts string"),
            ("documents", [(d, f"text {d}", "s", "en") for d in (0, 1, 2, 4, 5, 5, 6)], "doc_id long, text string, source string, lang string"),
            ("conversations", [(c, k, f"q{c}{k}") for c in (0, 2, 3) for k in range(3)], "conv_id long, turn long, text string"),
            ("customer", [(c,) for c in range(40)], "c_custkey long")):
        df = spark.createDataFrame(rows, schema)
        if name == "events":
            df = df.withColumn("ts", F.to_timestamp_ntz("ts"))
        df.write.parquet(f"{base}/{name}.parquet")
    return Tables(spark, base)


def _rows(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", ["latest_result_per_keyword", "cache_point_lookup", "cached_result_project", "result_merge"])
def test_winners_are_found_before_texts_are_joined(spark, name):
    joins = _joins(registry.queries()[name](spark, SF_SMALL))
    assert _first(joins, r"LeftOuter.*doc_id = doc_id") < _first(joins, r"LeftSemi, \((event_id|id) = ")


def test_rows_fetched_by_id_are_those_of_the_semi_join(spark, odd):
    for view in (fx.results, fx.results_full, fx.snapshot_full, fx.result_snapshot):
        assert _rows(R.latest_per_key(view(odd), fetch=lambda ids: view(odd, ids))) == _rows(R.latest_per_key(view(odd)))
        ids = spark.createDataFrame([(3,), (5,), (3,), (99,), (None,)], "i long")
        assert _rows(view(odd, ids)) == _rows(view(odd).join(ids.withColumnRenamed("i", "id"), "id", "left_semi"))


def test_rows_and_log_meet_before_texts(spark, odd):
    rows = spark.createDataFrame([(3, "a"), (8, "b"), (3, "c"), (99, "d"), (None, "e")], "hit long, tag string")
    full = fx.results_full(odd).select(F.col("id").alias("hit"), "paa_questions", "content")
    for how in ("inner", "left"):
        got = fx.join_results(odd, rows, "hit", how, ("paa_questions", "content"))
        assert _rows(got) == _rows(rows.join(full, "hit", how))
    joins = _joins(fx.join_results(odd, rows, "hit", "left", ("paa_questions", "content")))
    assert "doc_id" in joins[0] and "paa_conv_id" in joins[1]           # nothing is moved after the texts


def test_appended_results_read_no_stored_texts(spark):
    from quillspark.suite.plans import pipeline_records
    records = pipeline_records(Tables(spark, SF_SMALL)).filter((F.col("status") == "success") & (F.col("action") == "generate"))
    assert records.count() > 0
    assert not [x for x in _joins(records.select("request_id", "paa", "content")) if "doc_id" in x]


def test_cached_records_of_a_repeated_request(spark):
    from quillspark.plans.requests import _cached_records
    plan = spark.createDataFrame([(1, 7), (1, 7), (None, 7), (2, 8)], "request_id long, hit_id long").selectExpr(
        "request_id", "hit_id", "'u' AS user_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "'k' AS keyword")
    results = spark.createDataFrame([(7, ["q"], "seven"), (8, None, None)], "id long, paa_questions array<string>, content string")
    got = Counter((r.request_id, r.content, tuple(r.paa)) for r in _cached_records(plan, results).collect())
    assert got == {(1, "seven", ("q",)): 4, (None, "", ()): 1, (2, "", ()): 1}


def test_keyword_tasks_grow_with_the_rows(spark, monkeypatch):
    t = Tables(spark, SF_SMALL)
    want = _rows(fx.keywords(t))
    few = fx.keywords(t).rdd.getNumPartitions()
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 100)
    many = fx.keywords(t)
    assert many.rdd.getNumPartitions() == -(-t.lineitem.count() // 100) > few
    assert _rows(many) == want


def test_question_lists_are_not_stored_per_request(spark):
    """Nor do tables stay that only the plan was built on."""
    from quillspark.sinks.snapshots import written_stages
    from quillspark.suite.plans import pipeline_records
    with written_stages() as paths:
        records = pipeline_records(Tables(spark, SF_SMALL))
    names = {p.split("/")[-2]: p for p in paths}
    assert {"pipeline_plan", "crawled", "generated", "pair_rows"} <= set(names)
    for name in ("pipeline_plan", "crawled", "pair_rows"):
        assert "array" not in str(spark.read.parquet(names[name]).dtypes)
    assert records.filter("size(paa) > 0 AND action = 'generate'").count() > 0


def test_stages_that_nothing_reads_go(spark, monkeypatch):
    from quillspark.sinks import snapshots
    from quillspark.suite import plans
    gone = []
    monkeypatch.setattr(plans, "drop_stages", lambda s, paths: (gone.extend(paths), snapshots.drop_stages(s, paths)))
    assert plans.pipeline_records(Tables(spark, SF_SMALL), carry=()).count() == 1000
    assert {p.split("/")[-2] for p in gone} >= {"asof", "row_number"}
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    left = [p for p in gone if fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs.Path(p))]
    assert not left


def test_a_stage_table_leaves_no_shuffle_files(spark):
    import time

    from quillspark.sinks.snapshots import SHUFFLE_CLEANUP, materialize, materialize_buckets
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before, setting = shuffles(), spark.conf.get(SHUFFLE_CLEANUP, None)
    rows = spark.range(10_000).withColumn("k", F.col("id") % 7).repartition(8, "k")
    tables = [materialize(rows, "kept"), materialize_buckets(rows, "kept", "k", 8)]
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - before
    assert [t.count() for t in tables] == [10_000, 10_000]
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
