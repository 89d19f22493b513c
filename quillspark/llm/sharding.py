"""Sharding: contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import free_name, prefix_sums, row_hash, text_or_empty
from quillspark.sinks.snapshots import materialize


def shard_rows(rows: DataFrame, size: Column, order: list[Column], n_shards: int = 16) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard).

    Rows keep the global order of ``order``; a row goes to the shard whose
    equal share of all bytes holds the row's middle, so a shard is at most one
    row off its share. All columns of ``rows`` are carried, so pass narrow rows
    and join or write the texts afterwards (``write_shards``). Nulls in the
    order columns come first; equal rows may swap slots; an empty table gives
    an empty result; a row longer than a share leaves later shards emptier.
    """
    ranked = prefix_sums(rows, order, size, "shard_rows").withColumn(
        "shard", F.expr(f"((2 * _start + _size) * {n_shards}) div (2 * _total)").cast("int"))
    ranked = materialize(ranked, "shard_ranks")
    first = ranked.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return (ranked.join(F.broadcast(first), "shard")          # at most n_shards rows
            .withColumn("slot", F.col("_rank") - F.col("_first"))
            .drop("_first", "_rank", "_start", "_total", "_size"))


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 1; null text: 1),
    text_crc32, shard, slot. Order: doc_id, then checksum and size."""
    text = text_or_empty(text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(narrow, F.col("size"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], n_shards)


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Writes whole rows as ``path/shard=<n>/`` in slot order, every column of ``docs``
    as it is. A column of ``docs`` that is called shard or slot keeps its name;
    the shard's own then has underscores in front. Rows that share id, size and
    checksum (repeated rows; null and empty texts count alike) get one slot each,
    in the order of a hash of their columns. Null ids come first; an empty table
    writes no shard."""
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    text = text_or_empty(F.col(f"doc.{text_col}"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_hash(docs).alias("order"))
    rows = rows.withColumn("key", F.struct(F.col(f"doc.{id_col}").alias("i"), (F.octet_length(text) + 1).cast("long").alias("s"),
                                           F.crc32(text.cast("binary")).alias("c")))
    place = shard_documents(docs, n_shards, id_col, text_col).select(
        F.struct(F.col("doc_id").alias("i"), F.col("size").alias("s"), F.col("text_crc32").alias("c")).alias("key"), "shard", "slot")
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("order")))
    placed = place.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("shard", "slot")))
    (numbered.join(placed, ["key", "n"]).select("doc.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
     .repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).mode("overwrite").parquet(path))
