"""Registered queries: scans and sources (SRC4, SRC5, SRC7, SRC8) and the
scalar layer (S1, S2, S25, S33 / O7)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import schemas as S
from quillspark.functions.strings import (ASTRAL_PATTERN, JS_BLANK_PATTERN, JS_TRIM_PATTERN, LOG_ERROR_MARK, LOG_OK_MARK,
                                          js_is_blank, js_trim, log_severity, utf16_length)
from quillspark.functions.timefmt import elapsed_ms
from quillspark.operators import content as C
from quillspark.registry import query
from quillspark.sources import catalog as CAT
from quillspark.sources import fixtures as fx
from quillspark.sources import serp as SERP
from quillspark.sources.fixture_sql import with_views
from quillspark.sources.tables import Tables

ITEMS = 4                  # search result items per crawl run; a run's items are ITEMS conversations in turn
DURATION_SCALE = 1234567   # request duration fixture: value * 1.234567 seconds, in microseconds


@query("serp_first_item", with_views("paa_v") + f"""
SELECT f.run_id, f.conv_id, p.paa
FROM (SELECT conv_id // {ITEMS} AS run_id, arg_min(conv_id, conv_id % {ITEMS}) AS conv_id
      FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY conv_id // {ITEMS}) f
JOIN paa_v p ON p.conv_id = f.conv_id""")
def serp_first_item(spark, sf):
    t = Tables(spark, sf)
    items = fx.serp_items(t).withColumns({
        "run_id": F.expr(f"conv_id div {ITEMS}"), "pos": F.col("conv_id") % ITEMS})
    # The first item of each run is found before any item's questions are gathered.
    first = SERP.first_item(items, "run_id", "pos", "conv_id")
    docs = C.serp_documents(items.join(first.select("conv_id"), "conv_id", "left_semi"))
    return C.extract_paa(docs).join(first, "conv_id").select("run_id", "conv_id", "paa")


@query("request_decode", with_views("requests_v") + """
SELECT request_id, keyword, selected_model AS "selectedModel", custom_prompt AS "customPrompt",
       force_refresh AS "forceRefresh"
FROM requests_v""")
def request_decode(spark, sf):
    r = fx.requests(Tables(spark, sf))
    raw = r.select("request_id", SERP.encode_request(F.col("keyword"), F.col("selected_model"),
                                                     F.col("custom_prompt"), F.col("force_refresh")).alias("body"))
    return SERP.decode_requests(raw, "body", S.ANALYSE_REQUEST)


_PROPS = T.StructType([T.StructField("k", T.IntegerType())])


@query("event_props_decode", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def event_props_decode(spark, sf):
    """SRC5: the events' own JSON bodies."""
    raw = Tables(spark, sf).events.select("event_id", "props")
    return SERP.decode_requests(raw, "props", _PROPS)


@query("refine_decode", with_views("requests_v") + """
SELECT request_id, CASE WHEN request_id % 7 <> 0 THEN keyword END AS "originalContent",
       CASE WHEN request_id % 7 <> 0 THEN custom_prompt END AS "refinementPrompt",
       CASE WHEN request_id % 7 <> 0 AND request_id % 5 <> 0 THEN keyword END AS keyword
FROM requests_v""")
def refine_decode(spark, sf):
    """SRC5: refine bodies; every 7th is cut off, every 5th lacks its keyword."""
    r = fx.requests(Tables(spark, sf))
    body = SERP.encode_refine(F.col("keyword"), F.col("custom_prompt"),
                              F.when(F.col("request_id") % 5 != 0, F.col("keyword")))
    cut = F.when(F.col("request_id") % 7 == 0, F.substr(body, F.lit(1), F.greatest(F.length(body) - 1, F.lit(1)))).otherwise(body)
    return SERP.decode_requests(r.select("request_id", cut.alias("body")), "body", S.REFINE_REQUEST)


@query("catalog_table_count")
def catalog_table_count(spark, sf):
    """SRC7 (rows-only): the three application tables, registered from the fixtures."""
    t = Tables(spark, sf)
    CAT.register(spark, "user_usage", fx.usage(t))
    CAT.register(spark, "analysis_results", fx.results_full(t))
    CAT.register(spark, "content_refinements", t.events.select("event_id"))
    return CAT.table_count(spark, ["user_usage", "content_refinements", "analysis_results"])


@query("catalog_columns")
def catalog_columns(spark, sf):
    """SRC8 (rows-only): columns of user_keywords in ordinal order, with comments."""
    kw = fx.keywords(Tables(spark, sf))
    snap = kw.select(F.concat_ws("/", F.col("user_id").cast("string"), "keyword").alias("id"),
                     "user_id", "keyword", "created_at", F.col("created_at").alias("updated_at"))
    CAT.register(spark, "user_keywords", snap, S.USER_KEYWORDS)
    return CAT.columns(spark, "user_keywords")


@query("scalar_strings", f"""
SELECT doc_id,
       CAST(length(text) + length(regexp_replace(text, '{ASTRAL_PATTERN}', '', 'g')) AS INTEGER) AS utf16_length,
       CAST(length(text) AS INTEGER) AS code_points,
       regexp_replace(text, '{JS_TRIM_PATTERN}', '', 'g') = text AS already_trimmed,
       CAST(length(regexp_replace(text, '{JS_TRIM_PATTERN}', '', 'g')) AS INTEGER) AS trimmed_length,
       regexp_matches(text, '{JS_BLANK_PATTERN}') AS is_blank
FROM documents""")
def scalar_strings(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text")
    tr = js_trim(F.col("text"))
    return d.select("doc_id", utf16_length(F.col("text")).alias("utf16_length"),
                    F.length("text").alias("code_points"), (tr == F.col("text")).alias("already_trimmed"),
                    F.length(tr).alias("trimmed_length"), js_is_blank(F.col("text")).alias("is_blank"))


@query("request_duration", f"""
SELECT event_id, CAST(floor(CAST(round(value * {DURATION_SCALE}) AS BIGINT) / 1000.0 + 0.5) AS BIGINT) AS duration_ms
FROM events""")
def request_duration(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "ts", "value")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))
                             + F.round(F.col("value") * DURATION_SCALE).cast("long"))
    return e.select("event_id", elapsed_ms(F.col("ts"), end).alias("duration_ms"))


@query("activity_log", f"""
SELECT event_id, ts, msg,
       CASE WHEN contains(msg, '{LOG_OK_MARK}') THEN 'ok' WHEN contains(msg, '{LOG_ERROR_MARK}') THEN 'error'
            ELSE 'info' END AS severity
FROM (SELECT event_id, ts,
             '[' || strftime(ts, '%H:%M:%S') || '] ' ||
             CASE event_type WHEN 'purchase' THEN '{LOG_OK_MARK} ' WHEN 'error' THEN '{LOG_ERROR_MARK} ' ELSE '' END ||
             event_type || ' ' || CAST(user_id AS VARCHAR) AS msg
      FROM events)
ORDER BY ts DESC""")
def activity_log(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "ts", "event_type", "user_id")
    mark = (F.when(F.col("event_type") == "purchase", F.lit(LOG_OK_MARK + " "))
            .when(F.col("event_type") == "error", F.lit(LOG_ERROR_MARK + " ")).otherwise(F.lit("")))
    msg = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), mark, F.col("event_type"),
                   F.lit(" "), F.col("user_id").cast("string"))
    return (e.select("event_id", "ts", msg.alias("msg"))
             .withColumn("severity", log_severity(F.col("msg"))).orderBy(F.col("ts").desc()))
