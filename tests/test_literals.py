"""Written cases of the application's documents, as literal rows."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import codec
from quillspark.functions.strings import (first_truthy, js_is_blank, js_trim, log_severity,
                                          parse_int_or_zero, utf16_length)
from quillspark.operators.content import compliance_flags, paa_questions
from quillspark.plans.requests import use_cache_pipeline, use_cache_stream

# Base64 round trips: CJK, mixed, emoji, CJK punctuation.
BASE64_CASES = [["曼赤肯貓一隻多少錢？"], ["What is 曼赤肯貓?"], ["貓咪🐱的價格💰？"], ["「曼赤肯」是什麼？"]]


def test_base64_known_encoding(spark):
    df = spark.createDataFrame([(["曼赤肯貓一隻多少錢？"],)], "paa array<string>")
    got = df.select(codec.pack_list(F.col("paa")).alias("h")).first().h
    assert got == "WyLmm7zotaTogq/ospPkuIDpmrvlpJrlsJHpjKLvvJ8iXQ=="


@pytest.mark.parametrize("paa", BASE64_CASES)
def test_base64_round_trip(spark, paa):
    df = spark.createDataFrame([(paa,)], "paa array<string>")
    r = df.select(codec.unpack_list(codec.pack_list(F.col("paa"))).alias("back")).first()
    assert list(r.back) == paa


def test_base64_bad_payload_gives_empty(spark):
    df = spark.createDataFrame([("%%%not base64",), ("/w==",), (None,)], "h string")
    rows = df.select(codec.unpack_list(F.col("h")).alias("l")).collect()
    assert [list(r.l) for r in rows] == [[], [], []]


def test_empty_list_omits_header(spark):
    df = spark.createDataFrame([([],), (None,)], "paa array<string>")
    assert [r.h for r in df.select(codec.pack_list(F.col("paa")).alias("h")).collect()] == [None, None]


def test_cache_truth_table(spark):
    rows = [(False, None), (False, "tone"), (True, None), (True, "tone")]
    df = spark.createDataFrame(rows, "force boolean, custom string")
    got = [r.u for r in df.select(use_cache_stream(F.col("force"), F.col("custom")).alias("u")).collect()]
    assert got == [True, False, False, False]
    got = [r.u for r in df.select(use_cache_pipeline(F.col("force")).alias("u")).collect()]
    assert got == [True, True, False, False]


def test_js_trim_unicode_whitespace(spark):
    df = spark.createDataFrame([("\t  kw 　﻿\n",), ("   ",), ("a b",)], "s string")
    rows = df.select(js_trim(F.col("s")).alias("t"), js_is_blank(F.col("s")).alias("b")).collect()
    assert [(r.t, r.b) for r in rows] == [("kw", False), ("", True), ("a b", False)]


def test_utf16_length_counts_astral_twice(spark):
    df = spark.createDataFrame([("🐱",), ("貓a",), ("",)], "s string")
    assert [r.n for r in df.select(utf16_length(F.col("s")).alias("n")).collect()] == [2, 2, 0]


def test_parse_int_or_zero(spark):
    df = spark.createDataFrame([(" 69}",), ("abc",), ("-5x",), ("",), (None,), ("+7",)], "s string")
    assert [r.v for r in df.select(parse_int_or_zero(F.col("s")).alias("v")).collect()] == [69, 0, -5, 0, 0, 7]


def test_blank_question_is_not_replaced_by_title(spark):
    items = [("   ", "title", None, None), ("", "t2", None, None), (None, None, None, "q3"), ("", "", "", "")]
    df = spark.createDataFrame([(items,)], "items array<struct<question:string,title:string,text:string,query:string>>")
    got = df.select(paa_questions(F.col("items")).alias("p")).first().p
    assert list(got) == ["t2", "q3"]


def test_first_truthy(spark):
    df = spark.createDataFrame([("", " ", "x")], "a string, b string, c string")
    assert df.select(first_truthy(F.col("a"), F.col("b"), F.col("c")).alias("v")).first().v == " "


def test_compliance_flags_quirks(spark):
    df = spark.createDataFrame([(1, "| --- |"), (2, "### h"), (3, None), (4, ""), (5, "# x")], "id int, content string")
    rows = {r.id: r for r in compliance_flags(df).collect()}
    assert rows[1].has_table and rows[1].has_bullet          # '| --- |' counts as a bullet
    assert rows[2].has_heading                               # '### ' contains '## '
    assert rows[3].has_bluf is None and rows[4].has_table is None
    assert rows[5].has_bluf is False


def test_log_severity(spark):
    df = spark.createDataFrame([("✅ ok ❌",), ("❌ bad",), ("plain",)], "m string")
    assert [r.s for r in df.select(log_severity(F.col("m")).alias("s")).collect()] == ["ok", "error", "info"]


def test_fallback_list_branches(spark):
    from quillspark import schemas as S
    from quillspark.operators.keywords import keyword_list, with_fallback
    raw = spark.createDataFrame(
        [(1, 0, "a"), (1, 1, "b"),                                   # normal list: kept
         (2, 0, S.MISSING_FILE_SENTINEL),                            # missing file: fallback
         (3, 0, ""), (3, 1, None),                                   # only falsy cells: empty -> fallback
         (4, 0, "x"), (4, 1, "Error later")],                        # sentinel not first: kept
        "owner int, pos long, Keyword string")
    owners = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "owner int")   # 5 has no list at all
    out = with_fallback(keyword_list(raw, "Keyword", "pos"), owners, owner="owner")
    got = {}
    for r in out.collect():
        got.setdefault(r.owner, []).append((r.pos, r.keyword, r.source))
    fb = [(i, k, "fallback") for i, k in enumerate(S.FALLBACK_KEYWORDS)]
    assert sorted(got[1]) == [(0, "a", "list"), (1, "b", "list")]
    assert sorted(got[2]) == fb and sorted(got[3]) == fb and sorted(got[5]) == fb
    assert sorted(got[4]) == [(0, "x", "list"), (1, "Error later", "list")]


def test_result_map_merge_and_refine_overlay(spark):
    from quillspark.operators.results import merge_result_maps, overlay_results
    cur = spark.createDataFrame([("k1", ["q1"], "old", "cached"), ("k2", ["q2"], "", "cached"),
                                 ("k3", None, "keep", "cached")],
                                "keyword string, paa array<string>, content string, used_model string")
    inc = spark.createDataFrame([("k1", ["n1"], "new", "m"), ("k4", [], "fresh", "m")],
                                "keyword string, paa array<string>, content string, used_model string")
    merged = {r.keyword: r for r in merge_result_maps(cur, inc).collect()}
    assert (merged["k1"].content, list(merged["k1"].paa), merged["k1"].origin) == ("new", ["n1"], "incoming")
    assert merged["k3"].content == "keep" and merged["k4"].origin == "incoming"
    ref = spark.createDataFrame([("k1", "refined", "r-model"), ("k2", "refined2", "r-model"),
                                 ("k9", "orphan", "r-model")], "keyword string, content string, used_model string")
    over = {r.keyword: r for r in overlay_results(cur, ref).collect()}
    assert (over["k1"].content, over["k1"].used_model, list(over["k1"].paa)) == ("refined", "r-model", ["q1"])
    assert (over["k2"].content, over["k2"].used_model) == ("", "cached")     # nothing shown: no refine
    assert "k9" not in over and over["k3"].content == "keep"


def test_keyword_merge_order_and_prepend(spark):
    import datetime as dt

    from quillspark.operators.keywords import merge_lists, prepend_missing
    custom = spark.createDataFrame([(7, "c-old", dt.datetime(2024, 1, 1)), (7, "c-new", dt.datetime(2024, 2, 1))],
                                   "user_id long, keyword string, created_at timestamp_ntz")
    listed = spark.createDataFrame([(0, "l0"), (1, "c-new"), (2, "l0")], "pos long, keyword string")
    merged = [r.keyword for r in merge_lists(custom, listed).collect()]
    assert merged == ["c-new", "c-old", "l0", "c-new", "l0"]          # custom newest first; duplicates kept
    nulls = custom.unionByName(custom.limit(1).selectExpr("user_id", "'c-null' as keyword", "cast(null as timestamp_ntz) as created_at"))
    assert [r.keyword for r in merge_lists(nulls, listed).collect()][:2] == ["c-null", "c-new"]
    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    incoming = spark.createDataFrame([("l0", day[0]), ("h1", day[1]), ("h2", day[2]), ("h1", day[3])],
                                     "keyword string, created_at timestamp_ntz")
    pre = prepend_missing(listed, incoming).collect()
    assert [r.keyword for r in pre if r.src_rank == 0] == ["h2", "h1"]  # once, only when absent, newest first
    assert sorted(r.pos for r in pre if r.src_rank == 1) == [0, 1, 2]


def test_prefix_counts_utf16_units(spark):
    from quillspark.functions.strings import prefix
    texts = ["😀" * 200, "a" + "😀" * 200, "b" * 200, "short", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(prefix("t", 150).alias("p")).collect()]
    assert got == ["😀" * 75, "a" + "😀" * 74 + "\ufffd", "b" * 150, "short", None]


def test_limits_beyond_integer_are_refused(spark):
    from quillspark.functions.strings import parse_int_or_zero
    from quillspark.operators.usage import set_limits
    df = spark.createDataFrame([("99999999999",), ("9" * 40,), ("-" + "9" * 40,), (" 12x",), ("x",)], "t string")
    assert [r.v for r in df.select(parse_int_or_zero("t").alias("v")).collect()] == [99999999999, 2**63 - 1, -2**63, 12, 0]
    usage = spark.createDataFrame([("u1", 5, False), ("u2", 5, False)], "user_id string, max_usage int, is_premium boolean")
    changes = spark.createDataFrame([("c1", "u1", 1, 7, True), ("c2", "u1", 2, 99999999999, False), ("c3", "u2", 1, 0, True)],
                                    "change_id string, user_id string, ts int, max_usage long, is_premium boolean")
    got = {r.user_id: (r.max_usage, r.is_premium) for r in set_limits(usage, changes).collect()}
    assert got == {"u1": (7, True), "u2": (0, True)}


def test_generated_rows_keep_ids_and_report_failures(spark):
    from quillspark import schemas as S
    from quillspark.plans.generate import generate, stub_model
    big = 9007199254740993
    df = spark.createDataFrame([(big, "p", "m", None), (1, None, "m", "k"), (2, "p", "m", "error-1"), (None, "p", "m", "k")],
                               "request_id long, p string, m string, keyword string")
    got = {r.request_id: r for r in generate(df, "p", "m").collect()}
    assert set(got) == {big, 2} and got[big].generated == stub_model("p", "m", "")
    assert (got[2].generated, got[2].generation_error) == (None, "generation failed")
    none = generate(df, "p", "m", fn=lambda p, m, k: None).collect()
    assert all(r.generated is None and r.generation_error == S.MSG_GENERATION_FAILED for r in none)


def test_pipeline_records_of_odd_rows(spark):
    import datetime as dt

    from quillspark import schemas as S
    from quillspark.plans.requests import run_pipeline
    big = 9007199254740993
    t = dt.datetime(2024, 1, 1)
    plan = spark.createDataFrame(
        [(1, "u", t, "cached", "k", None, "cached", big, None), (2, "u", t, "generate", None, None, "m", None, "0/10"),
         (3, "u", t, "quota_error", "k", None, "m", None, "10/10"), (4, None, t, "login_error", "k", None, "m", None, None),
         (5, "u", t, "generate", "k", "x", "m", None, "1/10"), (6, "u", t, "generate", "error-k", None, "m", None, "2/10")],
        "request_id long, user_id string, ts timestamp_ntz, action string, keyword string, custom_prompt string, "
        "used_model string, hit_id long, label string")
    runs = spark.createDataFrame([(2, ["q"]), (6, ["q"])], "conv_id long, paa array<string>")
    results = spark.createDataFrame([(big, ["a"], "right"), (big - 1, ["b"], "wrong")], "id long, paa_questions array<string>, content string")
    got = {r.request_id: r for r in run_pipeline(plan, runs, F.col("request_id"), results).collect()}
    assert (got[1].status, got[1].content, got[1].draft_content, got[1].paa) == ("success", "right", "right", ["a"])
    assert got[2].status == "success" and got[2].draft_content and got[2].error_message is None
    assert got[3].error_message == S.MSG_QUOTA_BEFORE + "10/10" + S.MSG_QUOTA_AFTER + S.CONTACT
    assert (got[4].error_code, got[4].error_message) == ("login", S.MSG_PIPELINE_LOGIN)
    assert (got[5].error_code, got[5].error_message) == ("crawl", S.MSG_CRAWL_FAILED)
    assert (got[6].status, got[6].error_message, got[6].content) == ("error", "generation failed", "")


def test_ids_of_different_keys_differ(spark):
    from quillspark.functions.ids import key_uuid
    df = spark.createDataFrame([("a\x01b", "c"), ("a", "b\x01c"), ("", None), (None, "")], "x string, y string")
    assert df.select(key_uuid("x", "y").alias("i")).distinct().count() == 4


def test_all_documents_and_runs_are_reached(spark):
    from quillspark.sources import fixtures as fx
    from quillspark.sources.tables import Tables
    from tests.conftest import SF_SMALL
    t = Tables(spark, SF_SMALL)
    r = fx.results(t).select("id", "paa_conv_id").join(t.events.select(F.col("event_id").alias("id")), "id")
    docs = r.select((F.col("id") % fx.doc_count(t)).alias("doc_id")).distinct()
    assert docs.count() == t.documents.count()
    assert r.select("paa_conv_id").distinct().count() == t.conversations.select("conv_id").distinct().count()
