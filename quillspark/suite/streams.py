"""Registered queries: streaming operators (T1-T4) and chunk assembly.

Each streaming query stages its input as files in the shared folder, runs
the stream with ``availableNow`` to completion, and returns what its sink
holds as a batch DataFrame.
"""

from __future__ import annotations

from quillspark.registry import _ORACLES, query
from quillspark.session import shared_path
from quillspark.sinks.bucketed import BucketTable
from quillspark.sources import fixtures as fx
from quillspark.sources.fixture_sql import with_views
from quillspark.sources.tables import Tables
from quillspark.streaming import chunks as CH
from quillspark.streaming import quota as QS
from quillspark.streaming.runner import read_files, run_to_completion, stage_files, stage_in_order
from quillspark.streaming.signup import signup_batch_writer
from quillspark.suite.usage import USAGE_OUT

BATCHES = 4        # micro-batches per stream; their files grow with the shuffle parallelism


@query("chunk_assemble", "SELECT doc_id AS request_id, text FROM documents")
def chunk_assemble(spark, sf):
    return CH.assemble_batch(fx.chunks(Tables(spark, sf)))


def _chunk_stream(spark, sf):
    """Run T1 (+ T2 on finish); return (updates path, results-log path)."""
    t = Tables(spark, sf)
    # Chunks arrive in files by chunk number, so long answers span batches.
    src = stage_files(fx.chunks(t), "chunks", "chunk_no", "request_id")
    updates = shared_path(spark, "stream-out", "chunk_updates")
    log = shared_path(spark, "stream-out", "results_log")
    ckpt = shared_path(spark, "stream-ckpt", "chunks")

    # T1 stores every update once; T2 reads the finished answers back.
    table = CH.answer_table(spark, shared_path(spark, "tables", "answers"))
    stream = CH.assemble_stream(read_files(spark, src, CH.CHUNK_SCHEMA, BATCHES), table, updates,
                                lambda batch_id: CH.save_finished(spark, updates, log, batch_id))
    run_to_completion(spark, stream.option("checkpointLocation", ckpt))
    return updates, log


@query("stream_chunk_assemble", "SELECT doc_id AS request_id, text FROM documents")
def stream_chunk_assemble(spark, sf):
    updates, _ = _chunk_stream(spark, sf)
    return CH.joined_text(CH.update_log(spark, updates)).select("request_id", "text")


@query("stream_result_append", f"""
SELECT doc_id AS request_id, text AS content,
       CAST(greatest(1, ceil(strlen(text) / {fx.CHUNK_BYTES}.0)) AS BIGINT) AS n_chunks FROM documents""")
def stream_result_append(spark, sf):
    """One saved result per finished answer."""
    _, log = _chunk_stream(spark, sf)
    return spark.read.parquet(log).select("request_id", "content", "n_chunks")


def _quota_stream(spark, sf):
    """Run T3; return (decisions path, usage table). Requests arrive in time order."""
    t = Tables(spark, sf)
    req = fx.requests(t).select("request_id", "user_id", "ts")
    src = stage_in_order(req, "requests", "ts")
    out, base = shared_path(spark, "stream-out", "quota"), shared_path(spark, "tables", "quota_usage")
    ckpt = shared_path(spark, "stream-ckpt", "quota")
    table = QS.start_usage(fx.usage(t), base)
    stream = read_files(spark, src, req.schema, BATCHES)
    run_to_completion(spark, stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(QS.quota_batch_writer(table, out)))
    return out, table


@query("stream_quota", with_views("requests_v", "usage_v") + """
SELECT request_id, user_id, usage_before, (coalesce(is_premium, false) OR usage_before < max_usage) AS admitted
FROM (SELECT q.request_id, q.user_id, u.max_usage, u.is_premium,
             u.usage_count + CASE WHEN coalesce(u.is_premium, false) THEN rn - 1
                                  ELSE least(rn - 1, greatest(u.max_usage - u.usage_count, 0)) END AS usage_before
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS rn FROM requests_v) q
      JOIN usage_v u ON u.user_id = q.user_id)""")
def stream_quota(spark, sf):
    """The decisions of the stream."""
    out, _ = _quota_stream(spark, sf)
    return spark.read.parquet(out).select("request_id", "user_id", "usage_before", "admitted")


# The table after the stream is the batch's snapshot.
@query("stream_quota_table", _ORACLES["usage_increment"])
def stream_quota_table(spark, sf):
    """The usage table that the stream leaves, rows and deltas added up."""
    _, table = _quota_stream(spark, sf)
    return QS.current(table).select(*USAGE_OUT)


# Same final snapshot as the batch upsert over all signups at once: each
# account signs up once, so applying the batches in turn changes nothing.
@query("stream_signup_upsert", _ORACLES["usage_signup_upsert"])
def stream_signup_upsert(spark, sf):
    """T4: signups streamed in batches through the upsert; final snapshot."""
    t = Tables(spark, sf)
    usage = fx.usage(t).select(*USAGE_OUT)
    table = BucketTable(spark, shared_path(spark, "tables", "user_usage"), "user_id", usage.schema)
    table.create(usage)
    src = stage_files(fx.signups(t), "signups", "id")
    ckpt = shared_path(spark, "stream-ckpt", "signups")
    writer = signup_batch_writer(table, fx.admin_emails(t), fx.test_emails(t), fx.request_start())
    stream = read_files(spark, src, fx.signups(t).schema, BATCHES)
    run_to_completion(spark, stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(writer))
    return table.rows().select(*USAGE_OUT)
