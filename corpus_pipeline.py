"""Corpus pipeline: documents -> tokenised, filtered and mixed documents.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.bpe import encode_digests
from quillspark.llm.common import row_hash, text_or_empty
from quillspark.llm.exact import exact_dedup
from quillspark.llm.minhash import near_duplicates
from quillspark.llm.mixing import mix
from quillspark.llm.toxicity import toxicity_scores
from quillspark.sinks.snapshots import materialize


def keyed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``doc``, so that no column of the input can meet a
    name used here, with ``key`` (id and text) and ``order`` (hash of all columns)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       key(F.col("doc_id"), F.xxhash64(text_or_empty("text"))), row_hash(docs).alias("order"))


def key(doc_id: Column, text_hash: Column) -> Column:
    """Id and text as one value, which joins null ids too."""
    return F.struct(doc_id.alias("i"), text_hash.alias("t")).alias("key")


def staying(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``marked`` (doc_id, text_hash, kept) keeps, all columns as they are.

    Only the keys that lose rows are joined back. Of rows that agree in id and
    text as many stay as were kept, those of least hash over all columns."""
    gone = materialize(
        marked.groupBy(key(F.col("doc_id"), F.col("text_hash"))).agg(F.count_if("kept").alias("left"), F.count_if(~F.col("kept")).alias("lost"))
        .where("lost > 0").select("key", "left"), "pipeline_gone")
    rows = keyed(docs)
    out = rows.join(gone, "key", "left_anti").select("doc.*")
    some = gone.where("left > 0")
    if not some.isEmpty():
        nth = F.row_number().over(Window.partitionBy("key").orderBy("order"))
        out = out.unionByName(rows.join(some, "key").withColumn("nth", nth).where("nth <= left").select("doc.*"))
    return out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.5 or more) go.

    Null and empty texts are scored as empty; repeated rows share their fate; ids may
    be null; other columns are kept, whatever their names; an empty table stays one."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    rejected = toxicity_scores(docs, labels).where("predicted = 1").select(key(F.col("doc_id"), F.col("text_hash"))).distinct()
    return keyed(docs).join(rejected, "key", "left_anti").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, null ids last.

    Null texts count as empty; of repeated rows one stays (see ``staying``); other
    columns are kept, whatever their names; an empty table stays one."""
    return staying(docs, exact_dedup(docs).select("doc_id", "text_hash", "kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays.

    Texts without words are in no group and stay; for nulls, repeated rows, other
    columns and empty tables see ``drop_copies``."""
    return staying(docs, near_duplicates(docs).select("doc_id", "text_hash", "kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, all columns as they are.

    Texts without words are not taken; a null source is a source. Rows that agree in
    id and text get their copies in the order of a hash over all columns. An empty
    table stays one."""
    copies = mix(docs).where("copies > 0").select(key(F.col("doc_id"), F.col("text_hash")), "copies")
    in_order = Window.partitionBy("key").orderBy(F.desc("copies"))
    copies = copies.withColumn("nth", F.row_number().over(in_order))
    rows = keyed(docs).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("order")))
    return (rows.join(copies, ["key", "nth"])
            .select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the digests of ids and decoded text.

    Null texts count as empty; every row gives one, repeated ones too; an empty
    table gives an empty result."""
    return encode_digests(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("bpe", tokenise)]

# The classifier, the knapsack and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
