"""Helpers shared by the operators: word rules, global prefix sums, 64-bit mixing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sinks.snapshots import materialize

# White space between words, for Java and for Python's re.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: str | Column) -> Column:
    """Number of words, 0 for null and for blank texts."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as ``rows`` has such a column."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_hash(rows: DataFrame) -> Column:
    """Hash of all columns but maps: an order of rows that agree in their keys."""
    plain = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*plain)


def prefix_sums(rows: DataFrame, order: list[Column], size: Column, name: str) -> DataFrame:
    """Adds ``_start`` (sum of ``size`` before the row), ``_rank`` (rows before it)
    and ``_total`` (sum over all rows) in the global order of ``order``.

    The rows are range-partitioned and written once, which fixes the partition
    of each row. One total per partition (as many rows as shuffle partitions)
    is summed up and joined back, so no task sees more than its own range.
    Ties are split across ranges by a row number, so that equal keys do not
    pile up in one task; equal rows may swap places.
    """
    n = partitions(rows.sparkSession)
    placed = materialize(
        rows.withColumn("_size", size).withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *order, "_tie").withColumn("_part", F.spark_partition_id()), name)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (placed.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
              .select("_part", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
                      F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
                      F.sum("_bytes").over(Window.partitionBy()).alias("_total")))
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    return (placed.join(F.broadcast(before), "_part")        # one row per shuffle partition
            .withColumn("_start", F.col("_bytes_before") - F.col("_size")
                        + F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_rank", F.col("_rows_before") + F.row_number().over(inside) - 1)
            .drop("_part", "_tie", "_bytes_before", "_rows_before"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the MurmurHash3 one) over a uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def by_group(frames: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For ``mapInPandas`` over rows sorted by ``g``: ``work`` of each whole group,
    without the cost that a grouped map has for each of very many small groups."""
    rest = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        done = pdf["g"] != pdf["g"].iloc[-1]
        rest = pdf[~done]
        for _, rows in pdf[done].groupby("g", sort=False):
            yield work(rows)
    if rest is not None and len(rest):
        yield work(rest)
