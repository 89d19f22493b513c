"""Registered queries: appends to the result log."""

from __future__ import annotations

import logging

from pyspark.sql import functions as F

from quillspark.functions.ids import key_uuid, key_uuid_sql
from quillspark.registry import query
from quillspark.session import shared_path
from quillspark.sinks.snapshots import append
from quillspark.sources.tables import Tables
from quillspark.plans.generate import stub_sql
from quillspark.sources.fixture_sql import with_views
from quillspark.suite.plans import STATUS_CTES, pipeline_records

log = logging.getLogger(__name__)


def append_results(records, path: str) -> bool:
    """Append generated results; a failed write is logged, not raised."""
    rows = records.filter((F.col("status") == "success") & (F.col("action") == "generate")).select(
        key_uuid(F.lit("result"), "request_id").alias("id"), "keyword", F.col("paa").alias("paa_questions"), "content",
        F.col("ts").alias("created_at"))
    try:
        append(rows, path)
        return True
    except Exception as e:  # noqa: BLE001 - the application only logs a failed save
        log.error("result append failed: %s", e)
        return False


@query("result_append", with_views("requests_v", "results_full_v", "usage_v", "paa_v", extra=STATUS_CTES) + f"""
SELECT {key_uuid_sql("'result'", "request_id")} AS id, keyword, crawl_paa AS paa_questions, {stub_sql('rp', 'used_model')} AS content,
       ts AS created_at
FROM g3 WHERE crawl_ok AND NOT starts_with(keyword, 'error-')""")
def result_append(spark, sf):
    """Successful new results of the pipeline, appended and read back."""
    t = Tables(spark, sf)
    rec = pipeline_records(t, cached=False, carry=("ts", "keyword"))
    path = shared_path(spark, "tables", "analysis_results_log")
    append_results(rec, path)
    return spark.read.parquet(path)
