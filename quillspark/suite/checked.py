"""Registered queries: checked writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.operators.checked import check_rows, write_checked
from quillspark.registry import query
from quillspark.session import shared_path
from quillspark.sources import fixtures as fx
from quillspark.sources.fixture_sql import with_views
from quillspark.sources.tables import Tables

_CHECKED = {
    "a": """SELECT add_id, user_id, ts, CASE WHEN add_id % 19 = 0 THEN NULL ELSE keyword END AS keyword FROM keyword_adds_v""",
    "n": """SELECT *, CASE WHEN user_id IS NULL OR keyword IS NULL THEN '23502'
                           WHEN user_id NOT IN (SELECT id FROM live_users_v) THEN '23503' END AS bad FROM a""",
    "d": """SELECT add_id, row_number() OVER (PARTITION BY user_id, keyword ORDER BY ts, add_id) AS rn,
                   (user_id, keyword) IN (SELECT (user_id, keyword) FROM keywords_v) AS taken FROM n WHERE bad IS NULL""",
    "c": """SELECT n.add_id, n.user_id, n.keyword, coalesce(bad, CASE WHEN taken OR rn > 1 THEN '23505' END) AS error_code
            FROM n LEFT JOIN d ON d.add_id = n.add_id""",
}


def _written(spark, sf):
    """The batch of keyword adds written with checks; (table path, reject path)."""
    t = Tables(spark, sf)
    adds = fx.keyword_adds(t).select("add_id", "user_id", "ts", F.when(F.col("add_id") % 19 != 0, F.col("keyword")).alias("keyword"))
    checked = check_rows(adds, S.USER_KEYWORDS, ["ts", "add_id"], ["user_id", "keyword"], fx.keywords(t), {"user_id": (fx.live_users(t), "id")})
    paths = shared_path(spark, "tables", "keywords_checked"), shared_path(spark, "tables", "keywords_rejected")
    write_checked(checked, *paths)
    return paths


@query("keyword_write_stored", with_views("keyword_adds_v", "live_users_v", "keywords_v", extra=_CHECKED) + """
SELECT add_id, user_id, keyword FROM c WHERE error_code IS NULL""")
def keyword_write_stored(spark, sf):
    """The rows that pass NOT NULL, the reference to users and UNIQUE(user_id, keyword)."""
    return spark.read.parquet(_written(spark, sf)[0]).select("add_id", "user_id", "keyword")


@query("keyword_write_rejected", with_views("keyword_adds_v", "live_users_v", "keywords_v", extra=_CHECKED) + """
SELECT add_id, user_id, keyword, error_code FROM c WHERE error_code IS NOT NULL""")
def keyword_write_rejected(spark, sf):
    """The rows that don't, with the database's codes."""
    return spark.read.parquet(_written(spark, sf)[1]).select("add_id", "user_id", "keyword", "error_code")
