"""Line dedup: range-partitioned line hashes, first occurrences in document order,
per-document keep bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER, UPPER, partitions, text_or_empty
from quillspark.sinks.snapshots import materialize

# Fixed value: the white space stripped from both ends of a line.
STRIP = " \t\n\x0b\f\r"


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, slices: int = 64,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop: (doc_id, text_hash, pos), pos counted from 0.

    A line's key is the stripped line with A-Z in lower case. Hashes (128 bits)
    are range-partitioned together with a slice of the document id, so that a
    line in a third of all documents is spread over ``slices`` (1 to 64) ranges. Each
    range is sorted by hash, document (largest first) and position; windows
    stream over it to find the slice's first document and count its documents.
    Slices of a key are then added up, one row each.
    Documents are told apart by id and text hash; rows without an id count as
    one document that stands behind all others. Null and empty texts have one
    empty line, which is never dropped. Other columns are not read; repeated rows
    of an id and text are one document; an empty table gives an empty result.
    """
    if not 1 <= slices <= 64:
        raise ValueError("slices must be 1 to 64: a long holds a bit for each")
    n = partitions(docs.sparkSession)
    text = text_or_empty(text_col)
    key = F.translate(F.btrim(F.col("line"), F.lit(STRIP)), UPPER, LOWER)
    lines = (docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                         F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
             .withColumn("key", key).where(F.char_length("key") >= min_chars)
             .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.lit(1), "key").alias("h2"),
                     F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice")))
    lines = lines.repartitionByRange(n, "h1", "h2", "slice")
    in_slice = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc_nulls_last("doc_id"), "text_hash", "pos")
    streamed = materialize(lines.select("h1", "h2", "slice", "doc_id", "text_hash", "pos",
                                        F.first("doc_id").over(in_slice).alias("top"),
                                        F.dense_rank().over(Window.partitionBy("h1", "h2", "slice").orderBy(
                                            F.desc_nulls_last("doc_id"))).alias("nth_doc")), "line_stream")
    # One row per slice leaves the stream; keys in too few documents end here. A bit of ``in_slices``
    # says that a slice holds the key: rows meet their key's row by slice, so a hot key stays spread.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slice"))
    keys = (streamed.groupBy("h1", "h2", "slice").agg(F.max("nth_doc").alias("docs"), F.first("top").alias("top"))
            .groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("top").alias("keeper"), F.bit_or(bit).alias("in_slices"))
            .where(F.col("docs") >= min_docs)
            .select("h1", "h2", "keeper", F.explode(F.filter(
                F.sequence(F.lit(0), F.lit(slices - 1)), lambda k: F.getbit("in_slices", k) == 1)).alias("slice")))
    return (streamed.join(keys, ["h1", "h2", "slice"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .select("doc_id", "text_hash", "pos"))


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep bitmaps of documents that lose lines: (doc_id, text_hash, dropped_runs).

    ``dropped_runs`` is a run-length bitmap: ascending (start, length) runs of
    dropped line numbers; every line outside the runs is kept. Documents that
    lose nothing have no row, so a bitmap costs only what it says.
    """
    drops = repeated_lines(docs, min_chars, min_docs, id_col=id_col, text_col=text_col).distinct()
    by_doc = Window.partitionBy("doc_id", "text_hash").orderBy("pos")
    runs = (drops.withColumn("run", F.col("pos") - F.row_number().over(by_doc))
            .groupBy("doc_id", "text_hash", "run")
            .agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length")))
    return (runs.groupBy("doc_id", "text_hash")
            .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("dropped_runs")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text, dropped_runs."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("text_hash"))
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), "dropped_runs")
    joined = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")), "left")
    n_lines = (F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1).cast("long")
    gone = F.flatten(F.transform("dropped_runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    split = F.split("_text", "\n", -1)
    # Kept runs lie between dropped ones; slicing them costs one pass over the lines.
    starts = F.concat(F.array(F.lit(0)), F.transform("dropped_runs", lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform("dropped_runs", lambda r: r["start"]), F.array(F.col("n_lines").cast("int")))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(split, s + 1, F.greatest(e - s, F.lit(0)))))
    return (joined.withColumn("n_lines", n_lines)
            .select("doc_id", "n_lines", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("_g"), "_text",
                    "dropped_runs", F.when(F.col("dropped_runs").isNotNull(), F.array_join(kept, "\n")).alias("_kept"))
            .select("doc_id", "n_lines", F.when(F.col("dropped_runs").isNull(), 0).otherwise(F.col("_g")).alias("n_dropped"),
                    F.coalesce("_kept", "_text").alias("kept_text"), "dropped_runs"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops repeated long lines; see ``repeated_lines`` and ``apply_bitmaps``."""
    return apply_bitmaps(docs, line_bitmaps(docs, min_chars, min_docs, id_col, text_col), id_col, text_col)
