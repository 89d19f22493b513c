"""Registered queries: keyword lists, sets, validation and row security."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.functions.ids import key_uuid_sql
from quillspark.functions.strings import ASTRAL_PATTERN, JS_BLANK_PATTERN, JS_TRIM_PATTERN
from quillspark.functions.templates import sql_literal
from quillspark.operators import keywords as K
from quillspark.operators import security as SEC
from quillspark.registry import query
from quillspark.sinks.snapshots import materialize
from quillspark.sources import fixtures as fx
from quillspark.sources.fixture_sql import with_views
from quillspark.sources.tables import Tables

SEARCH_TERM = "Plate"
REMOVE_BEFORE = "1996-01-01 00:00:00"
TOUCH_AS_OF = "2024-02-01 00:00:00"


def _listed(t: Tables):
    """The keyword workbook: part names in part-key order."""
    return K.keyword_list(t.part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("Keyword")))


_LISTED_SQL = "SELECT p_partkey AS pos, p_name AS keyword FROM part WHERE p_name IS NOT NULL AND p_name <> ''"


@query("keyword_list_scan", _LISTED_SQL)
def keyword_list_scan(spark, sf):
    return _listed(Tables(spark, sf))


_FB_VALUES = ", ".join(f"({i}, {sql_literal(k)})" for i, k in enumerate(S.FALLBACK_KEYWORDS))


@query("keyword_list_fallback", f"""
WITH lists AS (SELECT s_nationkey AS owner, s_suppkey AS pos,
                      CASE WHEN s_acctbal < 0 THEN {sql_literal(S.MISSING_FILE_SENTINEL)} ELSE s_name END AS keyword
               FROM supplier),
stats AS (SELECT owner, arg_min(keyword, pos) AS first, count(*) AS n FROM lists GROUP BY owner),
o AS (SELECT n.n_nationkey AS owner,
             (s.n IS NULL OR coalesce(starts_with(s.first, 'Error'), false)) AS failed
      FROM nation n LEFT JOIN stats s ON s.owner = n.n_nationkey)
SELECT l.owner, l.pos, l.keyword, 'list' AS source FROM lists l JOIN o ON o.owner = l.owner AND NOT o.failed
UNION ALL
SELECT o.owner, f.pos, f.keyword, 'fallback' AS source
FROM o JOIN (VALUES {_FB_VALUES}) f(pos, keyword) ON o.failed""")
def keyword_list_fallback(spark, sf):
    t = Tables(spark, sf)
    s = t.supplier
    raw = s.select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("pos"),
                   F.when(F.col("s_acctbal") < 0, F.lit(S.MISSING_FILE_SENTINEL))
                    .otherwise(F.col("s_name")).alias("Keyword"))
    lists = K.keyword_list(raw, "Keyword", "pos")
    owners = t.nation.select(F.col("n_nationkey").alias("owner"))
    return K.with_fallback(lists, owners, owner="owner")


@query("keyword_merge", with_views("keywords_v") + f"""
SELECT 0 AS src_rank, user_id, keyword, created_at, NULL::BIGINT AS pos FROM keywords_v
UNION ALL
SELECT 1, NULL::BIGINT, keyword, NULL::TIMESTAMP, pos FROM ({_LISTED_SQL})""")
def keyword_merge(spark, sf):
    t = Tables(spark, sf)
    return K.merge_lists(fx.keywords(t), _listed(t))


@query("keyword_source_counts", with_views("keywords_v") + f"""
SELECT source, count(*) AS n_keywords FROM (
  SELECT 'custom' AS source FROM keywords_v UNION ALL SELECT 'listed' FROM ({_LISTED_SQL}))
GROUP BY ROLLUP (source)""")
def keyword_source_counts(spark, sf):
    t = Tables(spark, sf)
    m = K.merged_entries(fx.keywords(t), _listed(t))
    src = F.when(F.col("src_rank") == 0, "custom").otherwise("listed").alias("source")
    return K.source_counts(m.select(src))


@query("custom_keyword_set", """
SELECT DISTINCT o_custkey AS user_id, p_name AS keyword
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""")
def custom_keyword_set(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.select("l_orderkey", "l_partkey")
    o = t.orders.select("o_orderkey", "o_custkey")
    p = t.part.select("p_partkey", "p_name")
    raw = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return K.distinct_set(raw.select(F.col("o_custkey").alias("user_id"), F.col("p_name").alias("keyword")),
                          ["user_id", "keyword"])


@query("keyword_set_update", with_views("keywords_v", "keyword_adds_v") + f"""
SELECT user_id, keyword FROM (
  SELECT user_id, keyword FROM keywords_v
  UNION
  SELECT user_id, keyword FROM keyword_adds_v WHERE user_id IS NOT NULL AND add_id % 6 = 0)
EXCEPT
SELECT user_id, keyword FROM keywords_v WHERE created_at < TIMESTAMP '{REMOVE_BEFORE}'""")
def keyword_set_update(spark, sf):
    t = Tables(spark, sf)
    cur = materialize(fx.keywords(t), "keyword_set")       # read as the set and for what leaves it
    adds = fx.keyword_adds(t).filter(F.col("user_id").isNotNull() & (F.col("add_id") % 6 == 0))
    removes = cur.filter(F.col("created_at") < F.lit(REMOVE_BEFORE).cast("timestamp_ntz"))
    return K.update_set(cur, adds, removes, ["user_id", "keyword"])


@query("keyword_prepend_missing", with_views("results_v") + f"""
SELECT 0 AS src_rank, keyword, NULL::BIGINT AS pos, added_at
FROM (SELECT keyword, min(created_at) AS added_at FROM results_v GROUP BY keyword) r
WHERE keyword NOT IN (SELECT keyword FROM ({_LISTED_SQL}))
UNION ALL SELECT 1, keyword, pos, NULL FROM ({_LISTED_SQL})""")
def keyword_prepend_missing(spark, sf):
    t = Tables(spark, sf)
    return K.prepend_missing(_listed(t), fx.results(t).select("keyword", "created_at"))


@query("keyword_search", f"""
SELECT pos, keyword FROM ({_LISTED_SQL}) WHERE contains(lower(keyword), lower('{SEARCH_TERM}'))""")
def keyword_search(spark, sf):
    return K.search(_listed(Tables(spark, sf)), SEARCH_TERM)


@query("user_keywords_list", with_views("keywords_v") + """
SELECT user_id, keyword, created_at FROM keywords_v ORDER BY user_id, created_at DESC NULLS FIRST, keyword""")
def user_keywords_list(spark, sf):
    kw = fx.keywords(Tables(spark, sf))
    return kw.select("user_id", "keyword", "created_at").orderBy(
        "user_id", F.col("created_at").desc_nulls_first(), "keyword")


def _utf16_sql(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '{ASTRAL_PATTERN}', '', 'g')))"


_VALIDATE_CTE = {
    "adds": f"""SELECT *, regexp_replace(keyword, '{JS_TRIM_PATTERN}', '', 'g') AS keyword_trimmed
                FROM keyword_adds_v""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY user_id, keyword_trimmed ORDER BY ts, add_id) AS rn
                 FROM adds""",
    "validated": f"""
SELECT a.add_id, a.user_id, a.ts, a.keyword_trimmed,
       CASE WHEN a.user_id IS NULL THEN 'login'
            WHEN NOT coalesce(u.is_premium, false) THEN 'not_premium'
            WHEN a.keyword_trimmed = '' THEN 'empty'
            WHEN {_utf16_sql('a.keyword_trimmed')} > {S.MAX_KEYWORD_LENGTH} THEN 'too_long'
            WHEN k.user_id IS NOT NULL OR a.rn > 1 THEN 'duplicate'
            ELSE 'ok' END AS outcome,
       k.user_id IS NOT NULL AS in_custom
FROM ranked a
LEFT JOIN usage_v u ON u.user_id = a.user_id
LEFT JOIN keywords_v k ON k.user_id = a.user_id AND k.keyword = a.keyword_trimmed""",
}


@query("keyword_add_validate", with_views("keyword_adds_v", "usage_v", "keywords_v", extra=_VALIDATE_CTE) + f"""
SELECT add_id, user_id, keyword_trimmed, outcome,
       CASE outcome WHEN 'login' THEN {sql_literal(S.MSG_LOGIN_REQUIRED)}
                    WHEN 'not_premium' THEN {sql_literal(S.MSG_NOT_PREMIUM)}
                    WHEN 'empty' THEN {sql_literal(S.MSG_EMPTY_KEYWORD)}
                    WHEN 'too_long' THEN {sql_literal(S.MSG_TOO_LONG)}
                    WHEN 'duplicate' THEN {sql_literal(S.MSG_DUPLICATE)}
                    ELSE {sql_literal(S.MSG_ADDED)} END AS message
FROM validated""")
def keyword_add_validate(spark, sf):
    t = Tables(spark, sf)
    v = K.validate_adds(fx.keyword_adds(t), fx.usage(t), fx.keywords(t))
    return v.select("add_id", "user_id", "keyword_trimmed", "outcome", "message")


@query("keyword_add_validate_client", with_views("keyword_adds_v", "usage_v", "keywords_v",
                                                 extra=_VALIDATE_CTE) + f"""
, listed AS (SELECT DISTINCT keyword FROM ({_LISTED_SQL}))
SELECT v.add_id, v.user_id, v.keyword_trimmed,
       CASE WHEN a.keyword IS NULL OR regexp_matches(a.keyword, '{JS_BLANK_PATTERN}') THEN 'ignored'
            WHEN v.keyword_trimmed IN (SELECT keyword FROM listed) OR v.in_custom OR v.outcome = 'duplicate'
                 THEN 'duplicate'
            ELSE v.outcome END AS outcome
FROM validated v JOIN keyword_adds_v a ON a.add_id = v.add_id""")
def keyword_add_validate_client(spark, sf):
    """F12, client-first variant: blank inputs ignored, merged-list duplicates stopped early."""
    t = Tables(spark, sf)
    v = K.validate_adds_client(fx.keyword_adds(t), fx.usage(t), fx.keywords(t), _listed(t))
    return v.select("add_id", "user_id", "keyword_trimmed", "outcome")


@query("keyword_insert_dedup", with_views("keyword_adds_v", "usage_v", "keywords_v", extra=_VALIDATE_CTE) + f"""
SELECT {key_uuid_sql("user_id", "keyword")} AS id, user_id, keyword, created_at FROM (
  SELECT user_id, keyword, created_at FROM keywords_v
  UNION ALL
  SELECT user_id, keyword_trimmed, ts FROM validated WHERE outcome = 'ok')""")
def keyword_insert_dedup(spark, sf):
    t = Tables(spark, sf)
    kw = materialize(fx.keywords(t), "keyword_table")      # read for duplicates and as the old snapshot
    return K.insert_keywords(kw, K.validate_adds(fx.keyword_adds(t), fx.usage(t), kw))


@query("keyword_delete", with_views("keywords_v", "keyword_adds_v") + """
SELECT user_id, keyword, created_at FROM keywords_v k
WHERE NOT EXISTS (SELECT 1 FROM keyword_adds_v d WHERE d.user_id = k.user_id AND d.keyword = k.keyword)""")
def keyword_delete(spark, sf):
    t = Tables(spark, sf)
    return K.delete_keywords(fx.keywords(t), fx.keyword_adds(t))


@query("keyword_is_custom", with_views("keywords_v", "keyword_adds_v") + """
SELECT a.add_id, a.user_id, a.keyword, k.user_id IS NOT NULL AS is_custom
FROM keyword_adds_v a LEFT JOIN keywords_v k ON k.user_id = a.user_id AND k.keyword = a.keyword""")
def keyword_is_custom(spark, sf):
    t = Tables(spark, sf)
    return K.mark_custom(fx.keyword_adds(t).select("add_id", "user_id", "keyword"), fx.keywords(t))


@query("keyword_touch", with_views("keywords_v", "keyword_adds_v") + f"""
SELECT k.user_id, k.keyword, k.created_at,
       CASE WHEN EXISTS (SELECT 1 FROM keyword_adds_v a WHERE a.add_id % 6 = 0
                         AND a.user_id = k.user_id AND a.keyword = k.keyword)
            THEN TIMESTAMP '{TOUCH_AS_OF}' ELSE k.created_at END AS updated_at
FROM keywords_v k""")
def keyword_touch(spark, sf):
    t = Tables(spark, sf)
    kw = fx.keywords(t).withColumn("updated_at", F.col("created_at"))
    upd = fx.keyword_adds(t).filter(F.col("add_id") % 6 == 0)
    return K.touch(kw, upd, F.lit(TOUCH_AS_OF).cast("timestamp_ntz"))


@query("keyword_count", with_views("keywords_v") + """
SELECT 'user_keywords' AS message, count(*) AS initial_count FROM keywords_v""")
def keyword_count(spark, sf):
    return K.count_all(fx.keywords(Tables(spark, sf)), "user_keywords")


@query("keywords_per_user", with_views("keywords_v") + """
SELECT user_id, count(*) AS keywords_per_user FROM keywords_v GROUP BY user_id""")
def keywords_per_user(spark, sf):
    return K.per_user_counts(fx.keywords(Tables(spark, sf)))


@query("keyword_stats", with_views("keywords_v") + """
SELECT count(*) AS total_keywords, count(DISTINCT user_id) AS unique_users,
       avg(keywords_per_user) AS avg_per_user, CAST(sum(keywords_per_user) AS BIGINT) AS sum_keywords
FROM (SELECT user_id, count(*) AS keywords_per_user FROM keywords_v GROUP BY user_id)""")
def keyword_stats(spark, sf):
    return K.keyword_stats(fx.keywords(Tables(spark, sf)))


# ------------------------------------------------------------- row security
@query("rls_visible_rows", with_views("keywords_v", "requests_v") + """
SELECT k.user_id AS principal_id, k.keyword FROM keywords_v k
WHERE k.user_id IN (SELECT user_id FROM requests_v WHERE user_id IS NOT NULL)""")
def rls_visible_rows(spark, sf):
    t = Tables(spark, sf)
    principals = fx.requests(t).select(F.col("user_id").alias("principal_id"))
    return SEC.visible_rows(principals, fx.keywords(t).select("user_id", "keyword"))


@query("rls_insert_check", with_views("keyword_adds_v") + """
SELECT a.add_id, CASE WHEN a.add_id % 9 = 0 THEN a.user_id + 1 ELSE a.user_id END AS user_id,
       e.user_id AS writer_id,
       coalesce((CASE WHEN a.add_id % 9 = 0 THEN a.user_id + 1 ELSE a.user_id END) = e.user_id, false) AS accepted,
       CASE WHEN coalesce((CASE WHEN a.add_id % 9 = 0 THEN a.user_id + 1 ELSE a.user_id END) = e.user_id, false)
            THEN NULL ELSE '42501' END AS error_code
FROM keyword_adds_v a JOIN events e ON e.event_id = a.add_id""")
def rls_insert_check(spark, sf):
    t = Tables(spark, sf)
    a = fx.keyword_adds(t)
    # The writer is the signed-in actor of the event; every 9th add targets another user.
    writer = t.events.select(F.col("event_id").alias("add_id"), F.col("user_id").alias("writer_id"))
    batch = a.join(writer, "add_id").withColumn(
        "user_id", F.when(F.col("add_id") % 9 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return SEC.check_owner(batch.select("add_id", "user_id", "writer_id"))


@query("fk_cascade", with_views("keywords_v", "live_users_v") + """
SELECT user_id, keyword FROM keywords_v
WHERE user_id IS NULL OR user_id IN (SELECT id FROM live_users_v)""")
def fk_cascade(spark, sf):
    t = Tables(spark, sf)
    return SEC.cascade(fx.keywords(t).select("user_id", "keyword"), fx.live_users(t), "user_id")
