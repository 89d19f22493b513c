"""Running quota counter per user over a stream of requests.

The usage table is a log: rows in hash buckets of the user, and on top of them
deltas (user, admitted requests, last time). A micro-batch reads rows and deltas
of the buckets its users fall into, admits its requests in (ts, request_id) order
with the batch operator W2 (which splits a hot user over tasks), and writes its
decisions and one delta row per charged user, nothing else. Readers add the
deltas up; a compaction folds them into the rows of a bucket that has many. A
replayed micro-batch finds itself in the table's manifest and charges nothing.
Across micro-batches the result equals one batch admission when requests arrive
in time order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.usage import USAGE_COLS, admit
from quillspark.sinks.bucketed import FOLD_AFTER, BucketTable, stored

STREAM = "quota"


def usage_table(spark: SparkSession, base: str, schema: T.StructType, buckets: int | None = None) -> BucketTable:
    """The table handle; ``schema`` is that of the usage rows."""
    delta = T.StructType([schema["user_id"], T.StructField("added", T.LongType()), T.StructField("last_at", schema["last_used_at"].dataType)])
    return BucketTable(spark, base, "user_id", T.StructType([schema[c] for c in USAGE_COLS]), delta, buckets)


def start_usage(usage: DataFrame, base: str, buckets: int | None = None) -> BucketTable:
    """The table as it is before the first micro-batch."""
    table = usage_table(usage.sparkSession, base, usage.schema, buckets)
    table.create(usage)
    return table


def fold(rows: DataFrame, deltas: DataFrame) -> DataFrame:
    """Usage rows with their deltas added: count + admitted, newest time.
    A delta of a user without a row adds nothing, as an UPDATE would."""
    total = deltas.groupBy("user_id").agg(F.sum("added").alias("_added"), F.max("last_at").alias("_last"))
    j = rows.join(total, "user_id", "left")
    return j.select(*[
        (F.col("usage_count") + F.coalesce("_added", F.lit(0))).cast(rows.schema["usage_count"].dataType).alias(c) if c == "usage_count" else
        F.coalesce("_last", F.col(c)).cast(rows.schema[c].dataType).alias(c) if c == "last_used_at" else F.col(c) for c in USAGE_COLS])


def current(table: BucketTable, buckets: list[int] | None = None) -> DataFrame:
    """Usage as of the last commit."""
    return fold(table.rows(buckets), table.deltas(buckets))


def charges(decided: DataFrame) -> DataFrame:
    """D5 as a delta: one row per user with admitted requests."""
    return (decided.where("admitted").groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("added"), F.max("ts").alias("last_at")))


def quota_batch_writer(table: BucketTable, out: str, fold_after: int = FOLD_AFTER):
    """foreachBatch body: decisions to ``out/batch=<id>``, charges to the table's deltas."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        if table.done(STREAM, batch_id):
            return
        asked = stored(batch.select("request_id", "user_id", "ts"), f"quota_in_{batch_id}")
        known = current(table, table.touched(asked.where("user_id is not null")))
        decided = admit(asked, known).select("request_id", "user_id", "ts", "usage_before", "admitted")
        decided.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        decided = batch.sparkSession.read.schema(decided.schema).parquet(f"{out}/batch={batch_id}")
        table.add_deltas(charges(decided), STREAM, batch_id)
        table.compact(fold, fold_after)
    return apply
