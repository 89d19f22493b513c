"""Registered queries: usage, quota and account operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.functions.strings import JS_LEADING_INT_PATTERN, parse_int_or_zero
from quillspark.functions.templates import sql_literal
from quillspark.operators import usage as U
from quillspark.registry import query
from quillspark.session import shared_path
from quillspark.sinks.bucketed import BucketTable
from quillspark.sinks.snapshots import latest_version, materialize, write_snapshot
from quillspark.sources import fixtures as fx
from quillspark.sources.fixture_sql import with_views
from quillspark.sources.tables import Tables

USAGE_OUT = ["user_id", "email", "usage_count", "max_usage", "is_premium", "created_at", "last_used_at"]
_UCOLS = ", ".join(USAGE_OUT)


def _start():
    return fx.request_start()


@query("quota_exceeded", with_views("usage_v") + """
SELECT user_id, (usage_count >= max_usage AND NOT is_premium) AS exceeded FROM usage_v""")
def quota_exceeded(spark, sf):
    u = fx.usage(Tables(spark, sf))
    return u.select("user_id", U.exceeded(F.col("usage_count"), F.col("max_usage"), F.col("is_premium"))
                    .alias("exceeded"))


@query("scan_user_usage", with_views("usage_v") + f"""
SELECT {_UCOLS} FROM usage_v ORDER BY created_at DESC NULLS FIRST, user_id""")
def scan_user_usage(spark, sf):
    u = fx.usage(Tables(spark, sf))
    return u.select(*USAGE_OUT).orderBy(F.col("created_at").desc_nulls_first(), "user_id")


@query("usage_admin_report", with_views("usage_v") + f"""
SELECT user_id, email, usage_count, max_usage, usage_count >= max_usage AS at_limit,
       CASE WHEN is_premium THEN {sql_literal(S.PREMIUM_LABEL)} ELSE {sql_literal(S.REGULAR_LABEL)} END AS membership,
       coalesce(strftime(last_used_at, '%Y-%m-%d %H:%M'), {sql_literal(S.NEVER_USED_LABEL)}) AS last_used
FROM usage_v""")
def usage_admin_report(spark, sf):
    return U.admin_report(fx.usage(Tables(spark, sf)))


@query("usage_recent_top10", with_views("usage_v") + """
SELECT user_id, email, usage_count, max_usage, is_premium, last_used_at FROM usage_v
ORDER BY last_used_at DESC NULLS FIRST, user_id LIMIT 10""")
def usage_recent_top10(spark, sf):
    return U.recent_top(fx.usage(Tables(spark, sf)), S.RECENT_USAGE_LIMIT)


@query("user_usage_report", with_views("usage_v", "admins_v", "testers_v") + f"""
SELECT u.email, uu.usage_count, uu.max_usage, uu.is_premium,
       CASE WHEN u.email IN (SELECT email FROM admins_v) THEN {sql_literal(S.REPORT_LABEL_ADMIN)}
            WHEN u.email IN (SELECT email FROM testers_v) THEN {sql_literal(S.REPORT_LABEL_TEST)}
            ELSE {sql_literal(S.REPORT_LABEL_OTHER)} END AS account_type,
       uu.created_at
FROM users_v u LEFT JOIN usage_v uu ON u.id = uu.user_id
ORDER BY CASE WHEN u.email IN (SELECT email FROM admins_v) THEN 1
              WHEN u.email IN (SELECT email FROM testers_v) THEN 2 ELSE 3 END""")
def user_usage_report(spark, sf):
    t = Tables(spark, sf)
    return U.usage_report(fx.users(t), fx.usage(t), fx.admin_emails(t), fx.test_emails(t))


@query("admin_filter", with_views("users_v", "admins_v") + """
SELECT id, email FROM users_v WHERE email IN (SELECT email FROM admins_v)""")
def admin_filter(spark, sf):
    t = Tables(spark, sf)
    m = U.in_list(fx.users(t).select("id", "email"), "email", fx.admin_emails(t), out="_admin")
    return m.filter("_admin").drop("_admin")


@query("users_without_usage", with_views("users_v", "usage_v") + """
SELECT id AS user_id, email, 0 AS usage_count, 10 AS max_usage, false AS is_premium
FROM users_v WHERE id NOT IN (SELECT user_id FROM usage_v)""")
def users_without_usage(spark, sf):
    t = Tables(spark, sf)
    missing = U.not_in(fx.users(t), "id", fx.usage(t), "user_id")
    return missing.select(F.col("id").alias("user_id"), "email", F.lit(0).alias("usage_count"),
                          F.lit(S.DEFAULT_MAX_USAGE).alias("max_usage"), F.lit(False).alias("is_premium"))


@query("orphan_keywords", with_views("keywords_v", "usage_v") + """
SELECT user_id, keyword, created_at FROM keywords_v
WHERE user_id NOT IN (SELECT DISTINCT user_id FROM usage_v)""")
def orphan_keywords(spark, sf):
    """The keywords the cleanup deletes (the next snapshot is the rest)."""
    t = Tables(spark, sf)
    return U.not_in(fx.keywords(t), "user_id", fx.usage(t).select("user_id").distinct(), "user_id")


@query("orphan_keywords_next", with_views("keywords_v", "usage_v") + """
SELECT user_id, keyword, created_at FROM keywords_v
WHERE NOT coalesce(user_id NOT IN (SELECT DISTINCT user_id FROM usage_v), false)""")
def orphan_keywords_next(spark, sf):
    """The keyword table after the cleanup."""
    t = Tables(spark, sf)
    kw = materialize(fx.keywords(t), "orphan_keywords")
    gone = U.not_in(kw, "user_id", fx.usage(t).select("user_id").distinct(), "user_id")
    return kw.join(gone.select("user_id", "keyword"), ["user_id", "keyword"], "left_anti").select(
        "user_id", "keyword", "created_at")


@query("usage_insert_chosen", with_views("usage_v", "users_v") + f"""
SELECT {_UCOLS} FROM usage_v
UNION ALL
SELECT id, email, 0, 500, true, TIMESTAMP '{fx.REQUEST_START}', NULL FROM users_v
WHERE id % 13 = 0 AND id NOT IN (SELECT user_id FROM usage_v)""")
def usage_insert_chosen(spark, sf):
    """D16 + D17: new usage rows with chosen limits; unnamed columns take the table's
    defaults.  Written as the next version of the table and read back."""
    t = Tables(spark, sf)
    usage = fx.usage(t).select(*USAGE_OUT)
    chosen = (fx.users(t).filter(F.col("id") % 13 == 0).select(F.col("id").alias("user_id"), "email")
              .join(usage.select("user_id"), "user_id", "left_anti")
              .withColumns({"max_usage": F.lit(500), "is_premium": F.lit(True)}))
    new = S.fill_defaults(chosen, S.USER_USAGE, usage.schema, now=_start())
    base = shared_path(spark, "tables", "user_usage")
    write_snapshot(usage, base, 0)
    write_snapshot(usage.unionByName(new), base, latest_version(spark, base) + 1)
    return spark.read.parquet(f"{base}/v={latest_version(spark, base)}").select(*USAGE_OUT)


@query("usage_ensure_pipeline", with_views("usage_v", "users_v", "requests_v") + f"""
SELECT {_UCOLS} FROM usage_v
UNION ALL
SELECT u.id, u.email, 0, 10, false, TIMESTAMP '{fx.REQUEST_START}', NULL FROM users_v u
WHERE u.id IN (SELECT user_id FROM requests_v) AND u.id NOT IN (SELECT user_id FROM usage_v)""")
def usage_ensure_pipeline(spark, sf):
    """D4, the pipeline's rule: new rows are (0, 10, not premium), admins too."""
    t = Tables(spark, sf)
    req_users = fx.users(t).join(fx.requests(t).select(F.col("user_id").alias("id")), "id", "left_semi")
    return U.ensure(fx.usage(t), req_users, None, _start()).select(*USAGE_OUT)


@query("request_entitlement", with_views("requests_v", "usage_v") + """
SELECT q.request_id, q.user_id, u.user_id IS NOT NULL AS has_usage,
       coalesce(u.usage_count >= u.max_usage AND NOT u.is_premium, false) AS exceeded
FROM requests_v q LEFT JOIN usage_v u ON u.user_id = q.user_id""")
def request_entitlement(spark, sf):
    t = Tables(spark, sf)
    e = U.entitle(fx.requests(t).select("request_id", "user_id"), fx.usage(t))
    return e.select("request_id", "user_id", "has_usage", "exceeded")


@query("single_row_lookup", with_views("keywords_v", "requests_v") + """
SELECT k.user_id, coalesce(g.n_rows, 0) AS n_rows,
       CASE WHEN coalesce(g.n_rows, 0) = 0 THEN 'absent' WHEN g.n_rows = 1 THEN 'one' ELSE 'many' END AS status,
       CASE WHEN g.n_rows = 1 THEN g.keyword END AS keyword
FROM (SELECT DISTINCT user_id FROM requests_v WHERE user_id IS NOT NULL) k
LEFT JOIN (SELECT user_id, count(*) AS n_rows, min(keyword) AS keyword FROM keywords_v GROUP BY user_id) g
  ON g.user_id = k.user_id""")
def single_row_lookup(spark, sf):
    t = Tables(spark, sf)
    keys = fx.requests(t).filter(F.col("user_id").isNotNull()).select("user_id")
    return U.single(keys, fx.keywords(t), "user_id", "keyword")


_ADMIT_CTE = {
    "j": """SELECT q.request_id, q.user_id, q.ts, u.usage_count, u.max_usage, u.is_premium,
                   row_number() OVER (PARTITION BY q.user_id ORDER BY q.ts, q.request_id) AS rn
            FROM requests_v q JOIN usage_v u ON u.user_id = q.user_id""",
    "b": """SELECT *, usage_count + CASE WHEN coalesce(is_premium, false) THEN rn - 1
                                         ELSE least(rn - 1, greatest(max_usage - usage_count, 0)) END AS usage_before
            FROM j""",
    "adm": """SELECT *, (coalesce(is_premium, false) OR usage_before < max_usage) AS admitted FROM b""",
}


@query("quota_admission", with_views("requests_v", "usage_v", extra=_ADMIT_CTE) + """
SELECT request_id, user_id, rn, usage_before, admitted,
       usage_before + CASE WHEN admitted THEN 1 ELSE 0 END AS usage_after,
       CAST(usage_before AS VARCHAR) || '/' || CAST(max_usage AS VARCHAR) AS label
FROM adm""")
def quota_admission(spark, sf):
    t = Tables(spark, sf)
    a = U.admit(fx.requests(t).select("request_id", "user_id", "ts"), fx.usage(t))
    return a.select("request_id", "user_id", "rn", "usage_before", "admitted", "usage_after", "label")


@query("usage_increment", with_views("requests_v", "usage_v", extra=_ADMIT_CTE) + """
SELECT u.user_id, u.email, u.usage_count + coalesce(g.n, 0) AS usage_count, u.max_usage, u.is_premium,
       u.created_at, coalesce(g.last_ts, u.last_used_at) AS last_used_at
FROM usage_v u LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM adm WHERE admitted
                          GROUP BY user_id) g ON g.user_id = u.user_id""")
def usage_increment(spark, sf):
    t = Tables(spark, sf)
    usage = fx.usage(t)
    a = U.admit(fx.requests(t).select("request_id", "user_id", "ts"), usage)
    return U.charge(usage, a).select(*USAGE_OUT)


@query("parse_limit", with_views("limit_inputs_v") + f"""
SELECT event_id, raw_limit,
       coalesce(TRY_CAST(nullif(regexp_extract(raw_limit, '{JS_LEADING_INT_PATTERN}', 1), '') AS BIGINT), 0)
         AS parsed_limit
FROM limit_inputs_v""")
def parse_limit(spark, sf):
    e = fx.limit_inputs(Tables(spark, sf))
    return e.select("event_id", "raw_limit", parse_int_or_zero(F.col("raw_limit")).alias("parsed_limit"))


@query("usage_set_limits", with_views("usage_v", "limit_changes_v") + f"""
SELECT u.user_id, u.email, u.usage_count,
       CAST(CASE WHEN c.user_id IS NOT NULL THEN c.max_usage ELSE u.max_usage END AS INTEGER) AS max_usage,
       CASE WHEN c.user_id IS NOT NULL THEN c.is_premium ELSE u.is_premium END AS is_premium,
       u.created_at, u.last_used_at
FROM usage_v u LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, change_id DESC) AS rn
                 FROM limit_changes_v WHERE max_usage BETWEEN -2147483648 AND 2147483647) WHERE rn = 1) c ON c.user_id = u.user_id""")
def usage_set_limits(spark, sf):
    t = Tables(spark, sf)
    return U.set_limits(fx.usage(t).select(*USAGE_OUT), fx.limit_changes(t)).select(*USAGE_OUT)


@query("usage_reset", with_views("usage_v") + """
SELECT user_id, email,
       CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') THEN 0
            ELSE usage_count END AS usage_count,
       max_usage, is_premium, created_at, last_used_at
FROM usage_v""")
def usage_reset(spark, sf):
    t = Tables(spark, sf)
    return U.reset(fx.usage(t).select(*USAGE_OUT), fx.signup_user_ids(t)).select(*USAGE_OUT)


@query("usage_upgrade", with_views("usage_v", "users_v") + """
SELECT user_id, email, usage_count,
       CASE WHEN email IN (SELECT email FROM users_v WHERE id % 13 = 0) THEN 999999 ELSE max_usage END AS max_usage,
       CASE WHEN email IN (SELECT email FROM users_v WHERE id % 13 = 0) THEN true ELSE is_premium END AS is_premium,
       created_at, last_used_at
FROM usage_v""")
def usage_upgrade(spark, sf):
    t = Tables(spark, sf)
    emails = fx.users(t).filter(F.col("id") % 13 == 0).select("email")
    return U.upgrade(fx.usage(t).select(*USAGE_OUT), emails).select(*USAGE_OUT)


@query("usage_ensure", with_views("usage_v", "users_v", "admins_v", "requests_v") + f"""
SELECT {_UCOLS} FROM usage_v
UNION ALL
SELECT u.id, u.email, 0,
       CASE WHEN u.email IN (SELECT email FROM admins_v) THEN 999999 ELSE 10 END,
       u.email IN (SELECT email FROM admins_v),
       TIMESTAMP '{fx.REQUEST_START}', NULL
FROM users_v u
WHERE u.id IN (SELECT user_id FROM requests_v) AND u.id NOT IN (SELECT user_id FROM usage_v)""")
def usage_ensure(spark, sf):
    t = Tables(spark, sf)
    req_users = fx.users(t).join(fx.requests(t).select(F.col("user_id").alias("id")), "id", "left_semi")
    return U.ensure(fx.usage(t), req_users, fx.admin_emails(t), _start()).select(*USAGE_OUT)


@query("usage_signup_upsert", with_views("usage_v", "signups_v", "admins_v", "testers_v") + f"""
, s AS (SELECT id, email, email IN (SELECT email FROM admins_v) AS a, email IN (SELECT email FROM testers_v) AS t
        FROM signups_v)
SELECT coalesce(u.user_id, s.id) AS user_id,
       CASE WHEN s.id IS NOT NULL THEN s.email ELSE u.email END AS email,
       CASE WHEN u.user_id IS NULL THEN 0 ELSE u.usage_count END AS usage_count,
       CASE WHEN u.user_id IS NULL THEN (CASE WHEN s.a THEN 999999 ELSE 10 END)
            WHEN s.id IS NOT NULL AND s.a THEN 999999
            WHEN s.id IS NOT NULL AND s.t THEN 10
            ELSE u.max_usage END AS max_usage,
       CASE WHEN u.user_id IS NULL THEN s.a
            WHEN s.id IS NOT NULL AND s.a THEN true
            WHEN s.id IS NOT NULL AND s.t THEN false
            ELSE u.is_premium END AS is_premium,
       CASE WHEN u.user_id IS NULL THEN TIMESTAMP '{fx.REQUEST_START}' ELSE u.created_at END AS created_at,
       u.last_used_at
FROM usage_v u FULL OUTER JOIN s ON s.id = u.user_id""")
def usage_signup_upsert(spark, sf):
    t = Tables(spark, sf)
    return U.signup_upsert(fx.usage(t), fx.signups(t), fx.admin_emails(t), fx.test_emails(t),
                           _start()).select(*USAGE_OUT)


def _backfill_sql(ignore: bool) -> str:
    upd = "false" if ignore else "true"
    return with_views("usage_v", "users_v", "admins_v", "testers_v") + f"""
, s AS (SELECT id, email, email IN (SELECT email FROM admins_v) AS a, email IN (SELECT email FROM testers_v) AS t
        FROM users_v)
SELECT coalesce(u.user_id, s.id) AS user_id,
       CASE WHEN u.user_id IS NULL THEN s.email ELSE u.email END AS email,
       CASE WHEN u.user_id IS NULL THEN 0 ELSE u.usage_count END AS usage_count,
       CASE WHEN u.user_id IS NULL THEN (CASE WHEN s.a THEN 999999 ELSE 10 END)
            WHEN {upd} AND s.id IS NOT NULL AND s.a THEN 999999
            WHEN {upd} AND s.id IS NOT NULL AND s.t THEN 10
            ELSE u.max_usage END AS max_usage,
       CASE WHEN u.user_id IS NULL THEN s.a
            WHEN {upd} AND s.id IS NOT NULL AND s.a THEN true
            ELSE u.is_premium END AS is_premium,
       CASE WHEN u.user_id IS NULL THEN TIMESTAMP '{fx.REQUEST_START}' ELSE u.created_at END AS created_at,
       u.last_used_at
FROM usage_v u FULL OUTER JOIN s ON s.id = u.user_id"""


@query("usage_backfill", _backfill_sql(False))
def usage_backfill(spark, sf):
    t = Tables(spark, sf)
    return U.backfill(fx.usage(t), fx.users(t), fx.admin_emails(t), fx.test_emails(t),
                      _start()).select(*USAGE_OUT)


@query("usage_backfill_ignore", _backfill_sql(True))
def usage_backfill_ignore(spark, sf):
    t = Tables(spark, sf)
    return U.backfill(fx.usage(t), fx.users(t), fx.admin_emails(t), fx.test_emails(t),
                      _start(), ignore_conflicts=True).select(*USAGE_OUT)


_EDITS_CTE = {
    "u1": """SELECT u.user_id, u.email, u.usage_count,
                    CAST(CASE WHEN c.user_id IS NOT NULL THEN c.max_usage ELSE u.max_usage END AS INTEGER) AS max_usage,
                    CASE WHEN c.user_id IS NOT NULL THEN c.is_premium ELSE u.is_premium END AS is_premium, u.created_at, u.last_used_at
             FROM usage_v u LEFT JOIN (
               SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, change_id DESC) AS rn
                              FROM limit_changes_v WHERE max_usage BETWEEN -2147483648 AND 2147483647) WHERE rn = 1) c ON c.user_id = u.user_id""",
    "u2": """SELECT * REPLACE (CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') THEN 0
                                    ELSE usage_count END AS usage_count) FROM u1""",
    "hit": "SELECT email FROM users_v WHERE id % 13 = 0",
}


@query("usage_table_edits", with_views("usage_v", "users_v", "limit_changes_v", extra=_EDITS_CTE) + f"""
SELECT user_id, email, usage_count, CAST(CASE WHEN email IN (SELECT email FROM hit) THEN 999999 ELSE max_usage END AS INTEGER) AS max_usage,
       CASE WHEN email IN (SELECT email FROM hit) THEN true ELSE is_premium END AS is_premium, created_at, last_used_at
FROM u2""")
def usage_table_edits(spark, sf):
    """D6, D7 and D8 in turn on the stored table: each rewrites the buckets of its users only."""
    t = Tables(spark, sf)
    usage = fx.usage(t).select(*USAGE_OUT)
    table = BucketTable(spark, shared_path(spark, "tables", "usage_edits"), "user_id", usage.schema)
    table.create(usage)
    changes, chosen = materialize(fx.limit_changes(t), "limit_changes"), materialize(fx.signup_user_ids(t), "chosen")
    emails = fx.users(t).filter(F.col("id") % 13 == 0).select("email")
    table.update(lambda rows: U.set_limits(rows, changes), changes)
    table.update(lambda rows: U.reset(rows, chosen), chosen)
    table.update(lambda rows: U.upgrade(rows, emails), table.rows().join(emails, "email", "left_semi"))
    return table.rows().select(*USAGE_OUT)
