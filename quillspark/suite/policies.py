"""Registered queries: row policies for every command (F8, F9) and the cascade over all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import policies as P
from quillspark.registry import query
from quillspark.sources import fixtures as fx
from quillspark.sources.fixture_sql import with_views
from quillspark.sources.tables import Tables
from quillspark.suite.usage import USAGE_OUT

_UCOLS = ", ".join(USAGE_OUT)


def refinements(t: Tables):
    """Refinement log: requests with a custom prompt, the keyword as original text."""
    return fx.requests(t).where("custom_prompt is not null").select(
        F.col("request_id").alias("id"), "user_id", "keyword", F.col("custom_prompt").alias("refinement_prompt"), F.col("ts").alias("created_at"))


_REFINEMENTS = {"refinements_v": """SELECT request_id AS id, user_id, keyword, custom_prompt AS refinement_prompt, ts AS created_at
                                   FROM requests_v WHERE custom_prompt IS NOT NULL"""}


def _callers(t: Tables):
    return fx.requests(t).select(F.col("user_id").alias("caller")).where("caller is not null").distinct()


@query("rls_select_usage", with_views("usage_v", "requests_v") + f"""
SELECT user_id AS caller, {_UCOLS} FROM usage_v WHERE user_id IN (SELECT user_id FROM requests_v)""")
def rls_select_usage(spark, sf):
    t = Tables(spark, sf)
    return P.visible(_callers(t), fx.usage(t).select(*USAGE_OUT), "user_usage").select("caller", *USAGE_OUT)


@query("rls_select_refinements", with_views("requests_v", "signups_v", extra=_REFINEMENTS) + """
SELECT user_id AS caller, id, user_id, keyword, refinement_prompt, created_at FROM refinements_v
WHERE user_id IN (SELECT id FROM signups_v)""")
def rls_select_refinements(spark, sf):
    t = Tables(spark, sf)
    callers = fx.signups(t).select(F.col("id").alias("caller"))
    return P.visible(callers, refinements(t), "content_refinements").select("caller", "id", "user_id", "keyword", "refinement_prompt", "created_at")


@query("rls_select_results", with_views("results_v") + "\nSELECT id, keyword, NULL::BIGINT AS caller FROM results_v")
def rls_select_results(spark, sf):
    """Results are open to all: each row once, for any caller."""
    t = Tables(spark, sf)
    return P.visible(_callers(t), fx.results(t).select("id", "keyword"), "analysis_results").select("id", "keyword", "caller")


# Every user asks for the next user's row too; only their own is changed.
@query("rls_update_usage", with_views("usage_v", "limit_changes_v") + f"""
SELECT u.user_id, u.email, u.usage_count, CAST(coalesce(c.max_usage, u.max_usage) AS INTEGER) AS max_usage, u.is_premium,
       u.created_at, u.last_used_at
FROM usage_v u LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, change_id DESC) AS rn
                 FROM limit_changes_v WHERE max_usage BETWEEN -2147483648 AND 2147483647 AND change_id % 3 <> 0) WHERE rn = 1) c
  ON c.user_id = u.user_id""")
def rls_update_usage(spark, sf):
    """F8 UPDATE: edits by their users; every third is aimed at another user's row and skipped."""
    t = Tables(spark, sf)
    edits = fx.limit_changes(t).where(F.col("max_usage").between(-2**31, 2**31 - 1)).select(
        F.col("user_id").alias("caller"),
        F.when(F.col("change_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), "ts", "change_id", "max_usage")
    return P.update_rows(fx.usage(t).select(*USAGE_OUT), edits, ["user_id"], {"max_usage": F.col("req.max_usage")}, "user_usage",
                         ["ts", "change_id"])


@query("rls_delete_keywords", with_views("keywords_v") + """
SELECT user_id, keyword, created_at FROM keywords_v WHERE NOT (user_id % 3 = 1 AND length(keyword) % 2 = 0)""")
def rls_delete_keywords(spark, sf):
    """F8 DELETE: of the rows that are asked for, callers lose their own; the others' stay."""
    t = Tables(spark, sf)
    keywords = fx.keywords(t).select("user_id", "keyword", "created_at")
    asked = keywords.where(F.length("keyword") % 2 == 0).select(
        F.when(F.col("user_id") % 3 == 1, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("caller"), "user_id", "keyword")
    return P.delete_rows(keywords, asked, ["user_id", "keyword"], "user_keywords")


@query("rls_delete_refinements", with_views("requests_v", extra=_REFINEMENTS) + """
SELECT id, user_id, keyword, refinement_prompt, created_at FROM refinements_v""")
def rls_delete_refinements(spark, sf):
    """No DELETE policy on refinements: nothing matches, not even own rows."""
    t = Tables(spark, sf)
    rows = refinements(t)
    asked = rows.select(F.col("user_id").alias("caller"), "id")
    return P.delete_rows(rows, asked, ["id"], "content_refinements")


@query("rls_insert_results", with_views("requests_v") + """
SELECT request_id AS id, keyword, user_id AS caller, true AS accepted, NULL::VARCHAR AS error_code FROM requests_v""")
def rls_insert_results(spark, sf):
    """results take any writer, signed in or not."""
    t = Tables(spark, sf)
    batch = fx.requests(t).select(F.col("request_id").alias("id"), "keyword", F.col("user_id").alias("caller"))
    return P.insert_check(batch, "analysis_results")


@query("rls_insert_refinements", with_views("requests_v", extra=_REFINEMENTS) + """
SELECT id, CASE WHEN id % 8 = 0 THEN user_id + 1 ELSE user_id END AS user_id, user_id AS caller,
       coalesce(id % 8 <> 0 AND user_id IS NOT NULL, false) AS accepted,
       CASE WHEN coalesce(id % 8 <> 0 AND user_id IS NOT NULL, false) THEN NULL ELSE '42501' END AS error_code
FROM refinements_v""")
def rls_insert_refinements(spark, sf):
    """every eighth is written for another user, some without a signed-in user; both are rejected."""
    t = Tables(spark, sf)
    batch = refinements(t).select("id", F.when(F.col("id") % 8 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
                                  F.col("user_id").alias("caller"))
    return P.insert_check(batch, "content_refinements")


def _cascaded(spark, sf):
    t = Tables(spark, sf)
    users = fx.users(t).select("id", "email")
    tables = {"users": users, "user_usage": fx.usage(t).select(*USAGE_OUT), "content_refinements": refinements(t),
              "user_keywords": fx.keywords(t).select("user_id", "keyword")}
    return P.cascade_delete(tables, {"users": users.where(F.col("id") % 17 == 0).select("id")})


@query("fk_cascade_usage", with_views("usage_v", "users_v") + f"""
SELECT {_UCOLS} FROM usage_v WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM users_v WHERE id % 17 = 0)""")
def fk_cascade_usage(spark, sf):
    return _cascaded(spark, sf)["user_usage"]


@query("fk_cascade_refinements", with_views("requests_v", "users_v", extra=_REFINEMENTS) + """
SELECT id, user_id, keyword, refinement_prompt, created_at FROM refinements_v
WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM users_v WHERE id % 17 = 0)""")
def fk_cascade_refinements(spark, sf):
    return _cascaded(spark, sf)["content_refinements"]


@query("fk_cascade_keywords", with_views("keywords_v", "users_v") + """
SELECT user_id, keyword FROM keywords_v WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM users_v WHERE id % 17 = 0)""")
def fk_cascade_keywords(spark, sf):
    return _cascaded(spark, sf)["user_keywords"]
