"""Mixing sources to target weights by exact length counts and subset sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import prefix_sums, text_or_empty, word_count
from quillspark.session import ship_package
from quillspark.sinks.snapshots import materialize

WEIGHTS = (3, 1, 2)
WINDOW = 1 << 16


def source_targets(sizes: DataFrame, share: float = 1.5, max_repeat: int = 2,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes(source, source_size)``, one row per source -> + target (double).

    Sources in code point order, null last, weigh ``weights`` in turn. All
    share ``share`` times the total; a target stops at ``max_repeat`` times
    its source, the excess is shared again by weight until none is above.
    Only two sums a round reach the driver.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = prefix_sums(sizes, [F.col("source").isNull(), F.col("source")], F.lit(1), "mix_sources")
    s = materialize(ranked.select("source", "source_size", turn.alias("weight"),
                                  (F.col("source_size") * max_repeat).cast("double").alias("cap")), "mix_weights")
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped_before = 0.0, -1
    while True:
        at_cap = F.col("cap") < F.col("weight") * F.lit(level)
        capped, n, weight = s.agg(F.coalesce(F.sum(F.when(at_cap, F.col("cap"))), F.lit(0.0)),
                                  F.count(F.when(at_cap, 1)),
                                  F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0))).first()
        if n == capped_before or weight == 0:
            break
        level, capped_before = (total - capped) / weight, n
    return s.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level))).drop("weight", "cap")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to
    ``budget``, or come as near below it as the counts allow.

    Most of the budget is dealt in proportion to the counts. Single documents,
    longest first, then bring the rest under ``window``. The last part is a
    bounded knapsack: reachable sums as bits of one integer, counts split into
    powers of two, stopped as soon as the budget itself is reachable. Documents
    already taken are given back first until it covers the window.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    budget = min(budget, int((lengths * counts).sum()))
    if budget <= 0:
        return take
    share = budget / float((lengths * counts).sum())
    take = np.minimum(counts, np.floor(counts * share).astype(np.int64))
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= window:
            break
        more = min(int(counts[i] - take[i]), max(0, rest - window // 2) // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    # Give documents back until the window is open; a budget within it is solved as a whole.
    for i in np.argsort(-lengths, kind="stable"):
        if rest >= window:
            break
        back = min(int(take[i]), -(-(window - rest) // int(lengths[i])))
        take[i] -= back
        rest += back * int(lengths[i])
    full = (1 << (rest + 1)) - 1
    reach, items, history = 1, [], []
    for i in np.argsort(lengths, kind="stable"):
        left, step = int(counts[i] - take[i]), 1
        while left and not reach >> rest & 1:
            part = min(step, left)
            weight = part * int(lengths[i])
            if weight > rest:
                break
            history.append(reach)
            items.append((i, part, weight))
            reach = (reach | reach << weight) & full
            left, step = left - part, step * 2
    at = reach.bit_length() - 1
    for (i, part, weight), earlier in zip(reversed(items), reversed(history)):
        if not earlier >> at & 1:
            take[i] += part
            at -= weight
    return take


def _fit_source(pdf: pd.DataFrame, max_repeat: int) -> pd.DataFrame:
    """Copies of each length of one source: every document may be taken up to
    ``max_repeat`` times, ``whole`` times each and once more for ``extra_docs``."""
    pdf = pdf.sort_values("size")
    docs = pdf["docs"].to_numpy(np.int64)
    copies = fit_counts(pdf["size"].to_numpy(np.int64), docs * max_repeat, round(float(pdf["target"].iloc[0])))
    return pd.DataFrame({"source_key": pdf["source_key"], "size": pdf["size"], "whole": copies // docs, "extra_docs": copies % docs})


def mix(docs: DataFrame, seed: int = 17, share: float = 1.5, max_repeat: int = 2, weights: tuple[int, ...] = WEIGHTS,
        buckets: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, text_hash.

    Each source fills its target with copies, ``max_repeat`` of a document at most:
    counts by exact length (pre-aggregated, one row per source and length), one
    subset-sum fit per source, whose copies are dealt evenly over the documents
    of a length; the first ones by seeded hash get one more. Ranks are taken in ``buckets`` hash buckets of a source
    and length, so that a length in a third of all rows is split; bucket counts
    say how many of each bucket are wanted. Empty and null texts have size 0 and are
    never taken. Rows that share an id and size are interchangeable. The same
    seed and rows give the same result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    h = F.xxhash64(F.lit(seed), "doc_id")
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                   word_count(text_col).alias("size"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"))
                       .withColumn("h", h).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
                       # null sources need a key that joins; the mark keeps them apart from texts
                       .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))), "mix_rows")
    cells = materialize(rows.groupBy("source_key", "source", "size", "bucket").agg(F.count("*").alias("docs")), "mix_cells")
    sizes = cells.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    targets = materialize(source_targets(sizes, share, max_repeat, weights), "mix_targets").withColumn(
        "source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    lengths = (cells.where("size > 0").groupBy("source_key", "size").agg(F.sum("docs").alias("docs"))
               .join(targets.select("source_key", "target"), "source_key"))
    plan = materialize(lengths.groupBy("source_key").applyInPandas(
        lambda pdf: _fit_source(pdf, max_repeat), "source_key string, size long, whole long, extra_docs long"), "mix_plan")
    before = Window.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = (cells.where("size > 0").withColumn("earlier", F.coalesce(F.sum("docs").over(before), F.lit(0)))
             .join(plan, ["source_key", "size"])
             .select("source_key", "size", "bucket", "whole",
                     F.greatest(F.lit(0), F.col("extra_docs") - F.col("earlier")).alias("wanted")))
    nth = F.row_number().over(Window.partitionBy("source_key", "size", "bucket").orderBy("h", "doc_id", "text_hash"))
    copies = F.coalesce(F.col("whole") + F.when(F.col("nth") <= F.col("wanted"), 1).otherwise(0), F.lit(0))
    return (rows.withColumn("nth", nth).join(quota, ["source_key", "size", "bucket"], "left")
            .join(targets.drop("source"), "source_key")
            .select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"),
                    (copies * F.col("size")).cast("long").alias("taken"), "text_hash"))
