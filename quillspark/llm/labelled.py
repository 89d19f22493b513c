"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import held_out, text_or_empty
from quillspark.sinks.snapshots import materialize


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, name: str,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``per_class`` training rows of label 0 and of label 1, chosen by
    hash of the id: (text, label, weight, fold). Held-out ids are never taken;
    an id with several labels counts as its largest; ids without text or label
    don't count. ``weight`` restores the classes' true shares; ``fold`` (0 to 4)
    splits the sample. At most 2 * ``per_class`` ids are broadcast."""
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
           .where("doc_id is not null and label in (0, 1)").where(~held_out("doc_id"))
           .groupBy("doc_id").agg(F.max("label").alias("label")))
    one = one.withColumn("h", F.xxhash64(F.lit(label_col), "doc_id"))
    share = one.groupBy("label").agg(F.count("*").alias("n"))
    picked = None
    for label in (0, 1):
        part = one.where(F.col("label") == label).orderBy("h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.join(F.broadcast(share), "label").select(
        "doc_id", "label", (F.col("n") / F.least(F.col("n"), F.lit(per_class))).alias("weight"),
        F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)).cast("int").alias("fold"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id")                  # at most 2 * per_class ids
    # Repeated rows of an id may not outgrow the bound.
    return materialize(found.groupBy("doc_id", "label", "weight", "fold").agg(F.min("text").alias("text"))
                       .drop("doc_id"), name)
