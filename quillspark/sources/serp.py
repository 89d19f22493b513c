"""SERP datasets and request bodies (SRC4, SRC5).

A crawl run yields a list of items; only the first item's people-also-ask
block is used.  Request bodies arrive as JSON text and are decoded with an
explicit schema (no inference); an absent field decodes to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import schemas as S


def first_item(items: DataFrame, run: str, pos: str, item: str) -> DataFrame:
    """SRC4: the key of the first item (lowest ``pos``) of every run, as a
    partial aggregate (one row per run and partition is shuffled)."""
    g = items.groupBy(run).agg(F.min(F.struct(pos, item)).alias("_f"))
    return g.select(run, F.col("_f")[item].alias(item))


PAA_TYPE = "array<struct<question: string, title: string, text: string, query: string>>"


def read_items(spark: SparkSession, path: str, run: str = "run_id", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """SRC4 from JSON lines: (items, rejects).

    Items: run, pos, body (VARIANT), peopleAlsoAsk. A ``peopleAlsoAsk`` that is absent
    or no array gives an empty list (S14), whatever else the item holds; entries that
    are no objects are NULL. Lines that are no JSON, or name no run and place, go
    to rejects: value, reason. One parse per line, no schema inference."""
    lines = spark.read.text(path).withColumn("body", F.try_parse_json("value"))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("body", f"$.{name}", kind)
    typed = lines.select("value", "body", field(run, "long").alias(run), field(pos, "long").alias(pos),
                         F.coalesce(field("peopleAlsoAsk", PAA_TYPE), F.array().cast(PAA_TYPE)).alias("peopleAlsoAsk"))
    sound = F.col("body").isNotNull() & F.col(run).isNotNull() & F.col(pos).isNotNull()
    rejects = typed.where(~sound).select("value", F.when(F.col("body").isNull(), "not json").otherwise("no run or place").alias("reason"))
    return typed.where(sound).select(run, pos, "body", "peopleAlsoAsk"), rejects


def first_items(items: DataFrame, run: str = "run_id", pos: str = "pos") -> DataFrame:
    """The item of least place of every run; of items that share it the one whose text sorts first."""
    place = F.struct(F.col(pos), F.to_json("body"))
    least = items.groupBy(run).agg(F.min(place).alias("_f"))
    return items.join(least, run).where(F.struct(F.col(pos), F.to_json("body")) == F.col("_f")).dropDuplicates([run]).drop("_f")


def decode_requests(raw: DataFrame, body: str = "body", schema=S.ANALYSE_REQUEST) -> DataFrame:
    """SRC5: JSON body -> typed columns; absent fields, and all fields of a
    malformed body, are NULL."""
    mark = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(F.col(body), mark, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = F.when(parsed["_bad"].isNull(), parsed)
    return raw.select(*[c for c in raw.columns if c != body],
                      *[parsed[f.name].alias(f.name) for f in schema.fields])


def encode_request(keyword: Column, model: Column, custom: Column, force: Column) -> Column:
    """The body a client sends (NULL fields are omitted, as JSON.stringify drops undefined)."""
    return F.to_json(F.struct(keyword.alias("keyword"), model.alias("selectedModel"),
                              custom.alias("customPrompt"), force.alias("forceRefresh")))


def encode_refine(original: Column, prompt: Column, keyword: Column) -> Column:
    return F.to_json(F.struct(original.alias("originalContent"), prompt.alias("refinementPrompt"), keyword.alias("keyword")))
