"""Incremental assembly of a streamed answer and the save on finish.

Chunks are byte pieces ``(request_id, chunk_no, chunk, is_last)``; a
multi-byte character may straddle two chunks. An update emits the characters it
adds to the running text; the sink is the log of these pieces, and each is
written once. State per request holds no text: the next wanted number, the bytes
of a cut character and early (out-of-order) chunks. It is a table in hash buckets
with a commit log, as T3's: a micro-batch reads the buckets its requests fall
into, takes one step for all of them in one grouping (``assemble_step``) and adds one delta
per request. An answer is put together
from its pieces when it is finished; as the state knows the micro-batch of its
first piece, only the log's partitions from there on are read. Redelivered
chunks are ignored: those below the next wanted number at once, and for a
finished request all of them, as long as its mark is kept (``FINISHED_MS``). A
replayed micro-batch finds itself in the table's manifest and changes nothing.
"""

from __future__ import annotations

import codecs
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from quillspark.sinks.bucketed import FOLD_AFTER, BucketTable

STREAM = "answers"
FINISHED_MS = 3_600_000        # how long a finished request is remembered
BATCH_ID = "streaming.sql.batchId"      # local property that tasks of a micro-batch see

CHUNK_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("chunk_no", T.LongType()),
    T.StructField("chunk", T.BinaryType()),
    T.StructField("is_last", T.BooleanType()),
])

OUT_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("first_batch", T.LongType()),
    T.StructField("n_chunks", T.LongType()),
    T.StructField("added", T.StringType()),
    T.StructField("done", T.BooleanType()),
])

STATE_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("batch", T.LongType()),          # micro-batch of the last change
    T.StructField("first_batch", T.LongType()),
    T.StructField("next_no", T.LongType()),
    T.StructField("last_no", T.LongType()),
    T.StructField("held", T.BinaryType()),
    T.StructField("early", T.ArrayType(T.StructType([T.StructField("no", T.LongType()), T.StructField("chunk", T.BinaryType())]))),
    T.StructField("kept_until", T.LongType()),     # of a finished request: when its mark goes, in ms
])
STATE = [f for f in STATE_SCHEMA.names if f != "request_id"]

# The start of a character at the end of bytes that are read as ISO-8859-1: a lead
# byte and continuation bytes that may follow it, one fewer than it asks for at least
# (of a surrogate too, as ``decode_piece`` holds them).
CUT = ("(?:[\\xC2-\\xF4]"
       "|(?:\\xE0[\\xA0-\\xBF]|[\\xE1-\\xEF][\\x80-\\xBF])"
       "|(?:\\xF0[\\x90-\\xBF]|\\xF4[\\x80-\\x8F]|[\\xF1-\\xF3][\\x80-\\xBF])[\\x80-\\xBF]?)\\z")


def decode_piece(held: bytes, new: bytes, final: bool) -> tuple[str, bytes]:
    """Characters that ``held + new`` completes, and the bytes of a cut character
    that wait; invalid bytes become U+FFFD, as a streaming text decoder emits them."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    text = decoder.decode(held + new, final)
    return text, decoder.getstate()[0]


def _assemble(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The step of one request by plain loops: the rule that ``assemble_step`` is tested against."""
    if state.hasTimedOut:
        state.remove()
        return
    if state.exists:
        first_batch, next_no, last_no, held, early_no, early, finished = state.get
        if finished:
            state.setTimeoutDuration(FINISHED_MS)
            return
        waiting = dict(zip(early_no or [], early or []))
    else:
        context = TaskContext.get()
        first_batch = int((context and context.getLocalProperty(BATCH_ID)) or 0)
        next_no, last_no, held, waiting = 0, -1, b"", {}
    for pdf in batches:
        for no, chunk, last in zip(pdf["chunk_no"], pdf["chunk"], pdf["is_last"]):
            if int(no) >= next_no:
                waiting[int(no)] = bytes(chunk)
                last_no = int(no) if last else last_no
    parts = []
    while next_no in waiting:
        parts.append(waiting.pop(next_no))
        next_no += 1
    done = 0 <= last_no < next_no
    added, held = decode_piece(bytes(held), b"".join(parts), done)
    if done:
        state.update((first_batch, next_no, last_no, b"", [], [], True))
        state.setTimeoutDuration(FINISHED_MS)
    else:
        nos = sorted(waiting)
        state.update((first_batch, next_no, last_no, held, nos, [waiting[n] for n in nos], False))
    yield pd.DataFrame({"request_id": [key[0]], "first_batch": [first_batch], "n_chunks": [next_no], "added": [added], "done": [done]})


def answer_table(spark: SparkSession, base: str, buckets: int | None = None) -> BucketTable:
    """The state table of T1; it starts without commits."""
    return BucketTable(spark, base, "request_id", STATE_SCHEMA, STATE_SCHEMA, buckets)


def newest(rows: DataFrame, deltas: DataFrame, now_ms: int) -> DataFrame:
    """The last state of each request, without marks that are no longer kept."""
    last = rows.unionByName(deltas).groupBy("request_id").agg(F.max(F.struct(*STATE)).alias("_s")).select("request_id", "_s.*")
    return last.where(F.col("kept_until").isNull() | (F.col("kept_until") > now_ms))


def assemble_step(chunks: DataFrame, states: DataFrame, batch_id: int, now_ms: int) -> DataFrame:
    """T1 on the chunks of a micro-batch and the stored states: one row per request
    of the micro-batch, its update and its new state; ``again`` marks a finished
    request, which has no update. Of chunks with one number the largest counts, those of the micro-batch first.
    """
    state = F.struct(*STATE)
    arrived = chunks.select("request_id", F.struct(F.col("chunk_no").alias("no"), "chunk", "is_last").alias("_c"),
                            F.lit(None).cast(T.StructType([STATE_SCHEMA[f] for f in STATE])).alias("_s"))
    known = states.select("request_id", F.lit(None).cast(arrived.schema["_c"].dataType).alias("_c"), state.alias("_s"))
    met = arrived.unionByName(known).groupBy("request_id").agg(F.collect_list("_c").alias("_c"), F.max("_s").alias("_s")).where(F.size("_c") > 0)
    gone = F.coalesce(F.col("_s.kept_until") <= now_ms, F.lit(False))
    was = met.withColumn("_s", F.when(~gone, F.col("_s"))).select(
        "request_id", F.col("_s.kept_until").isNotNull().alias("again"),
        F.coalesce("_s.first_batch", F.lit(batch_id)).cast("long").alias("first_batch"),
        F.coalesce("_s.next_no", F.lit(0)).cast("long").alias("_next"), F.coalesce("_s.last_no", F.lit(-1)).cast("long").alias("_last"),
        F.coalesce("_s.held", F.lit(b"")).alias("_held"), F.coalesce("_s.early", F.array().cast(STATE_SCHEMA["early"].dataType)).alias("_early"), "_c")
    new = was.withColumn("_c", F.filter("_c", lambda c: ~F.col("again") & (c["no"] >= F.col("_next"))))
    waiting = new.withColumn("_w", F.sort_array(F.concat(
        F.transform("_c", lambda c: F.struct(c["no"].alias("no"), F.lit(True).alias("new"), c["chunk"].alias("chunk"))),
        F.transform("_early", lambda c: F.struct(c["no"].alias("no"), F.lit(False).alias("new"), c["chunk"].alias("chunk"))))))
    once = waiting.withColumn("_w", F.filter("_w", lambda c, i: F.coalesce(F.get("_w", i + 1)["no"] != c["no"], F.lit(True))))
    # The numbers ascend from the wanted one on: where one is missing, all after it are too far.
    parted = (once.withColumn("_run", F.filter("_w", lambda c, i: c["no"] == F.col("_next") + i))
              .withColumn("_last", F.coalesce(F.array_max(F.transform(F.filter("_c", lambda c: c["is_last"]), lambda c: c["no"])), "_last"))
              .withColumn("next_no", F.col("_next") + F.size("_run"))
              .withColumn("done", (F.col("_last") >= 0) & (F.col("_last") < F.col("next_no"))))
    # Joined as hex text: linear, unlike repeated binary concat.
    joined = parted.withColumn("_b", F.concat("_held", F.unhex(F.array_join(F.transform("_run", lambda c: F.hex(c["chunk"])), ""))))
    cut = F.length(F.regexp_extract(F.decode(F.substring("_b", -3, 3), "ISO-8859-1"), CUT, 0))
    ready = joined.withColumn("_n", F.octet_length("_b") - F.when(F.col("done"), 0).otherwise(cut))
    no_text = (F.size("_run") > 0) & (F.octet_length("_b") == 0) & F.forall("_run", lambda c: c["chunk"].isNull())
    return ready.select(
        "request_id", "first_batch", F.col("next_no").alias("n_chunks"),
        F.when(~no_text, F.make_valid_utf8(F.substring("_b", F.lit(1), F.col("_n")).cast("string"))).alias("added"),
        "done", "again", F.lit(batch_id).cast("long").alias("last_batch"), "next_no", F.col("_last").alias("last_no"),
        F.substring("_b", F.col("_n") + 1, F.lit(3)).alias("held"),
        F.when(F.col("done"), F.array().cast(STATE_SCHEMA["early"].dataType)).otherwise(F.transform(
            F.filter("_w", lambda c, i: c["no"] != F.col("_next") + i), lambda c: F.struct(c["no"].alias("no"), c["chunk"].alias("chunk")))).alias("early"),
        F.when(F.col("done"), F.lit(now_ms + FINISHED_MS)).cast("long").alias("kept_until"))


def assemble_batch_writer(table: BucketTable, updates: str, then: Callable[[int], None] | None = None,
                          now: Callable[[], float] = time.time, fold_after: int = FOLD_AFTER):
    """foreachBatch body: updates to ``updates/batch=<id>``, then ``then(id)``, then the states to the table's deltas."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        if table.done(STREAM, batch_id):
            return
        now_ms, path = int(now() * 1000), f"{updates}/batch={batch_id}"
        buckets = table.touched(batch) if table.versions() else []
        step = assemble_step(batch, table.rows(buckets).unionByName(table.deltas(buckets)), batch_id, now_ms)
        step.write.mode("overwrite").parquet(path)
        if then:
            then(batch_id)
        left = batch.sparkSession.read.schema(step.schema).parquet(path).withColumn("batch", F.col("last_batch"))
        table.add_deltas(left.select(*STATE_SCHEMA.names), STREAM, batch_id)
        table.compact(lambda rows, deltas: newest(rows, deltas, now_ms), fold_after)
    return apply


def assemble_stream(chunks: DataFrame, table: BucketTable, updates: str, then: Callable[[int], None] | None = None) -> DataStreamWriter:
    """T1 on a streaming DataFrame of chunks: one stored row per request and update."""
    return chunks.writeStream.foreachBatch(assemble_batch_writer(table, updates, then))


def update_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored updates, partitioned by micro-batch."""
    full = T.StructType([*OUT_SCHEMA.fields, T.StructField("again", T.BooleanType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(full).option("basePath", path).parquet(path).where(~F.col("again")).drop("again")


def running_text(updates: DataFrame) -> DataFrame:
    """The running text after each stored update: what was added so far, in order."""
    so_far = Window.partitionBy("request_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return updates.withColumn("text", F.array_join(F.collect_list("added").over(so_far), ""))


def joined_text(updates: DataFrame, *by: str) -> DataFrame:
    """(request_id, text, n_chunks) of finished answers: the pieces of one answer, in order;
    without a text when no piece has one."""
    pieces = updates.groupBy(*by or ["request_id"]).agg(F.sort_array(F.collect_list(F.struct("batch", "added"))).alias("_p"), F.count("added").alias("_n"),
                                               F.max("n_chunks").alias("n_chunks"), F.bool_or("done").alias("_done"))
    return pieces.where("_done").select("request_id", F.when(F.col("_n") > 0, F.array_join(F.col("_p.added"), "")).alias("text"), "n_chunks")


def save_finished(spark: SparkSession, updates: str, log: str, batch_id: int) -> None:
    """The answers that a stored micro-batch finished, saved once. Those it began
    as well are whole; the earlier pieces of the others lie between the first micro-batch of the
    oldest of them and this one, in updates that finished nothing. They meet in one grouping."""
    stored = update_log(spark, updates)
    finished = stored.where((F.col("batch") == batch_id) & F.col("done"))
    whole = finished.where(F.col("first_batch") == batch_id).select("request_id", F.col("added").alias("text"), "n_chunks")
    oldest = finished.agg(F.min("first_batch")).first()[0]
    if oldest is not None and oldest < batch_id:
        before = stored.where(F.col("batch").between(oldest, batch_id - 1) & ~F.col("done"))
        # An update knows its answer's first micro-batch: pieces of an earlier answer with the same id stay apart.
        whole = whole.unionByName(joined_text(before.unionByName(finished.where(F.col("first_batch") < batch_id)), "request_id", "first_batch"))
    (whole.select("request_id", F.col("text").alias("content"), "n_chunks").write.mode("overwrite").parquet(f"{log}/batch={batch_id}"))


def assemble_batch(chunks: DataFrame) -> DataFrame:
    """Ordered concatenation of all chunks per request, decoded once.

    Chunks are ordered by number inside the group and joined as hex text
    (linear, unlike repeated binary concat), then unhexed and decoded.
    """
    g = chunks.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("_c"))
    hexed = F.array_join(F.transform("_c", lambda c: F.hex(c["chunk"])), "")
    # Invalid bytes become U+FFFD, as a streaming text decoder emits them.
    return g.select("request_id", F.make_valid_utf8(F.unhex(hexed).cast("string")).alias("text"))
