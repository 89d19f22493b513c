"""Registered queries: the result log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillspark.operators import results as R
from quillspark.registry import _ORACLES, query
from quillspark.session import shared_path
from quillspark.sinks.daylog import DayLog
from quillspark.sources import fixtures as fx
from quillspark.sources.fixture_sql import with_views
from quillspark.sources.tables import Tables

# Fixed "now" of the reports, so results repeat.
DAILY_AS_OF = "2024-01-31 00:00:00"
RETENTION_AS_OF = "2024-02-15 00:00:00"


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def _latest_sql(src: str, cols: str = "*") -> str:
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY keyword "
            f"ORDER BY created_at DESC NULLS FIRST, id DESC) AS _rn FROM {src}) WHERE _rn = 1")


def newest_snapshot(t: Tables):
    """The snapshot's newest result of every keyword."""
    return R.latest_per_key(fx.snapshot_full(t), fetch=lambda ids: fx.snapshot_full(t, ids))


@query("latest_result_per_keyword", with_views("results_v") + _latest_sql(
    "results_v", "keyword, id, content, paa_conv_id, created_at"))
def latest_result_per_keyword(spark, sf):
    t = Tables(spark, sf)
    return R.latest_per_key(fx.results(t), fetch=lambda ids: fx.results(t, ids))


@query("cache_point_lookup", with_views("snapshot_v", "requests_v") + _latest_sql(
    "snapshot_v", "keyword, id, content, paa_conv_id, created_at")
    + " AND keyword IN (SELECT keyword FROM requests_v)")
def cache_point_lookup(spark, sf):
    t = Tables(spark, sf)
    wanted = fx.requests(t).select("keyword")
    newest = R.latest_per_key(fx.result_snapshot(t), fetch=lambda ids: fx.result_snapshot(t, ids))
    return newest.join(wanted, "keyword", "left_semi")


@query("cache_asof_lookup", with_views("requests_v", "results_v") + """
SELECT q.request_id, q.keyword, r.id AS hit_id, r.created_at AS hit_created_at
FROM requests_v q ASOF LEFT JOIN results_v r ON q.keyword = r.keyword AND q.ts > r.created_at""")
def cache_asof_lookup(spark, sf):
    t = Tables(spark, sf)
    res = fx.results(t)
    q = R.cache_lookup(fx.requests(t).select("request_id", "keyword", "ts"), res)
    hit = R.attach_hit(q, res, [F.col("created_at").alias("hit_created_at")])
    return hit.select("request_id", "keyword", "hit_id", "hit_created_at")


@query("analysis_history", with_views("results_full_v") + """
SELECT id, keyword, paa_questions, content, created_at FROM results_full_v
ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 20""")
def analysis_history(spark, sf):
    return R.history(fx.results_full(Tables(spark, sf)))


@query("cached_result_project", with_views("snapshot_full_v") + f"""
SELECT keyword, coalesce(paa_questions, []::VARCHAR[]) AS paa, coalesce(content, '') AS content,
       coalesce(content, '') AS draft_content, 'success' AS status, 'cached' AS used_model
FROM ({_latest_sql("snapshot_full_v")})""")
def cached_result_project(spark, sf):
    return R.to_cached_result(newest_snapshot(Tables(spark, sf)))


@query("daily_analysis", with_views("results_v") + f"""
SELECT count(*) AS total_analyses, count(DISTINCT keyword) AS unique_keywords,
       CAST(created_at AS DATE) AS date, count(*) AS daily_count
FROM results_v WHERE created_at > TIMESTAMP '{DAILY_AS_OF}' - INTERVAL 7 DAY
GROUP BY CAST(created_at AS DATE) ORDER BY date DESC""")
def daily_analysis(spark, sf):
    return R.daily_counts(fx.results(Tables(spark, sf)), _ts(DAILY_AS_OF), 7)


@query("retention_delete", with_views("results_v") + f"""
SELECT id, keyword, created_at FROM results_v
WHERE NOT coalesce(created_at < TIMESTAMP '{RETENTION_AS_OF}' - INTERVAL 30 DAY, false)""")
def retention_delete(spark, sf):
    nxt = R.retain(fx.results(Tables(spark, sf)), _ts(RETENTION_AS_OF), 30)
    return nxt.select("id", "keyword", "created_at")


@query("paa_chart", with_views("requests_v", "snapshot_full_v", extra={
    "latest": _latest_sql("snapshot_full_v", "keyword, paa_questions")}) + """
SELECT q.request_id, q.keyword,
       CAST(CASE WHEN l.keyword IS NOT NULL THEN len(coalesce(l.paa_questions, []::VARCHAR[])) ELSE 0 END
            AS INTEGER) AS paa_count,
       CASE WHEN l.keyword IS NOT NULL THEN 'success' ELSE 'pending' END AS status
FROM requests_v q LEFT JOIN latest l ON l.keyword = q.keyword""")
def paa_chart(spark, sf):
    t = Tables(spark, sf)
    result_map = R.to_cached_result(newest_snapshot(t))
    return R.paa_chart(fx.requests(t).select("request_id", "keyword"), result_map)


_MERGE_CTE = {
    "cur": _latest_sql("snapshot_full_v", "keyword, id, content, created_at"),
    "inc": _latest_sql("(SELECT * FROM results_full_v WHERE created_at >= TIMESTAMP '2024-01-16 00:00:00')",
                       "keyword, id, content, created_at"),
}


@query("result_merge", with_views("snapshot_full_v", "results_full_v", extra=_MERGE_CTE) + """
SELECT coalesce(i.keyword, c.keyword) AS keyword,
       CASE WHEN i.keyword IS NOT NULL THEN i.id ELSE c.id END AS id,
       CASE WHEN i.keyword IS NOT NULL THEN i.content ELSE c.content END AS content,
       CASE WHEN i.keyword IS NOT NULL THEN i.created_at ELSE c.created_at END AS created_at,
       CASE WHEN i.keyword IS NOT NULL THEN 'incoming' ELSE 'current' END AS origin
FROM cur c FULL OUTER JOIN inc i ON c.keyword = i.keyword""")
def result_merge(spark, sf):
    t = Tables(spark, sf)
    cols = ["keyword", "id", "content", "created_at"]

    def incoming(ids=None):
        return fx.results_full(t, ids).filter(F.col("created_at") >= fx.request_start())
    cur = newest_snapshot(t).select(*cols)
    inc = R.latest_per_key(incoming(), fetch=incoming).select(*cols)
    return R.merge_result_maps(cur, inc)


def _day_log(spark, sf):
    """The result log by days, appended in two parts."""
    rows = fx.results(Tables(spark, sf)).select("id", "keyword", "created_at")
    log = DayLog(spark, shared_path(spark, "tables", "day_log"), rows.schema)
    for part in (0, 1):
        log.append(rows.where(F.coalesce(F.col("id") % 2, F.lit(0)) == part))
    return log


# The log by days gives what the delete and the report over the whole log give.
@query("retention_day_log", _ORACLES["retention_delete"])
def retention_day_log(spark, sf):
    """Whole days are dropped, the cut day is rewritten."""
    log = _day_log(spark, sf)
    log.retain(datetime.fromisoformat(RETENTION_AS_OF), 30)
    return log.rows().select("id", "keyword", "created_at")


@query("daily_rollup", _ORACLES["daily_analysis"])
def daily_rollup(spark, sf):
    """A4: whole days from the rollup, the cut day from its folder of the log."""
    return _day_log(spark, sf).daily_counts(datetime.fromisoformat(DAILY_AS_OF), 7)
