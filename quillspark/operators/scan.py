"""Skew-tolerant ordered scans per key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts every row of a key in
one task; one key holding a third of the table then holds a third of the job.
Here the rows are range-partitioned on (key, order), which cuts a hot key
wherever its rows are, whatever their times: a burst, an outlier or NULL times
do not pile up. The placed rows are written once as a stage table bucketed by
their range, so the row-level window per (key, range) runs on the ranges as
they lie there, without a second exchange of rows. Only the first key of a
range can have rows in earlier ranges; what it brings along (a row count, the
last id seen) is one row per range, carried forward over that small table and
broadcast back. The result equals the plain window exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sinks.snapshots import materialize_buckets

RANGE = ["_slot", "_part"]      # bucket of a range, number of a range


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` range-partitioned on (keys, order), with its range number ``_part``
    and ``_slot``, the value whose bucket holds this range alone."""
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    # One row per bucket: the smallest number that Spark's bucketing puts there.
    slots = (spark.range(0, 64 * n, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("_part"))
             .agg(F.min("id").alias("_slot")))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    rows = (ranged.join(F.broadcast(slots), "_part", "left")
            .select(*df.columns, "_part", F.coalesce("_slot", F.col("_part").cast("long")).alias("_slot")))
    return materialize_buckets(rows, name, "_slot", n)


def _carried(per_key: DataFrame, keys: list[str], value: str, total) -> DataFrame:
    """From one row per key and range with ``value``: one row per range with its
    first key ``_first`` and ``_carry``, what ``total(value)`` over the earlier
    ranges of this key comes to (NULL: none). Ranges follow the keys, so a range's first
    key is in an earlier range only if it is the last key of the one before."""
    key = F.struct(*keys)
    edges = per_key.groupBy(*RANGE).agg(F.min(key).alias("_first"), F.max(key).alias("_last"),
                                        F.max_by(value, key).alias("_v"))
    so_far = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_order = Window.orderBy("_part")                  # one row per range
    run = edges.withColumn("_run", total("_v").over(so_far))
    same = F.lag("_last").over(in_order).eqNullSafe(F.col("_first"))
    return run.select("_part", "_first", F.when(same, F.lag("_run").over(in_order)).alias("_carry"))


def keyed_row_number(df: DataFrame, keys: list[str], order: list[Column], out: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without a per-key task.

    ``order`` must end with a unique tiebreak.  Keys may be NULL (a NULL key
    is a group, as in a window).
    """
    rows = placed(df, keys, order, "row_number")
    local = rows.withColumn("_lrn", F.row_number().over(Window.partitionBy(*RANGE, *keys).orderBy(*order)))
    counts = rows.groupBy(*RANGE, *keys).agg(F.count(F.lit(1)).alias("_n"))
    j = local.join(F.broadcast(_carried(counts, keys, "_n", F.sum)), "_part")      # one row per shuffle partition
    before = F.when(F.struct(*keys).eqNullSafe(F.col("_first")), F.coalesce("_carry", F.lit(0))).otherwise(0)
    return j.select(*df.columns, (before + F.col("_lrn")).cast("long").alias(out))


def global_row_number(df: DataFrame, order: list[Column], out: str = "rn") -> DataFrame:
    """``row_number()`` over the whole table in ``order``; one row per range is carried."""
    rows = placed(df, [], order, "global_row_number")
    counts = rows.groupBy(*RANGE).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*RANGE).orderBy(*order))
    j = rows.withColumn("_lrn", local).join(F.broadcast(offs), "_part")       # one row per shuffle partition
    return j.select(*df.columns, (F.col("_off") + F.col("_lrn")).cast("long").alias(out))


def asof_last_id(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str,
                 right_ts: str, right_id: str, out: str = "match_id", strict: bool = True) -> DataFrame:
    """As-of join returning only the matched id (of any orderable type).

    For every ``left`` row: the ``right_id`` of the newest ``right`` row with
    the same keys and ``right_ts < left_ts`` (``<=`` when not strict); ties on
    time go to the larger id.  Left rows keep all their columns; NULL keys or
    times never match.  Carry only the id and join payload back by id.
    """
    kind_left = 0 if strict else 2
    lcols = left.columns
    not_null = reduce(lambda a, c: a & c, [F.col(k).isNotNull() for k in keys], F.col(right_ts).isNotNull())
    r = (right.filter(not_null)
         .select(*keys, F.col(right_ts).alias("_t"), F.col(right_id).alias("_rid"), F.lit(1).alias("_k"),
                 F.lit(0).cast("long").alias("_s")))
    # ``_s`` lets range edges fall between requests of the same key and time.
    lft = left.withColumns({"_t": F.col(left_ts), "_k": F.lit(kind_left), "_s": F.monotonically_increasing_id()})
    order = [F.col("_t"), F.col("_k"), F.col("_rid"), F.col("_s")]
    u = placed(lft.unionByName(r, allowMissingColumns=True), keys, order, "asof")
    w = (Window.partitionBy(*RANGE, *keys).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = u.withColumn("_in", F.last("_rid", ignorenulls=True).over(w)).filter(F.col("_k") == kind_left)
    newest = F.max(F.when(F.col("_k") == 1, F.struct("_t", "_rid")))
    per_key = u.groupBy(*RANGE, *keys).agg(newest.alias("_n")).select(*RANGE, *keys, F.col("_n._rid").alias("_n"))
    carry = _carried(per_key, keys, "_n", lambda c: F.last(c, ignorenulls=True))
    j = hits.join(F.broadcast(carry), "_part")          # one row per shuffle partition
    earlier = F.when(F.struct(*keys).eqNullSafe(F.col("_first")), F.col("_carry"))
    return j.select(*lcols, F.coalesce("_in", earlier).alias(out))
