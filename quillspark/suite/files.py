"""Registered queries: inputs read back from files that may be missing, empty or broken (SRC1, SRC2, SRC4, S14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.functions.templates import sql_literal
from quillspark.operators import content as C
from quillspark.operators import keywords as K
from quillspark.registry import query
from quillspark.session import shared_path
from quillspark.sources import fixtures as fx
from quillspark.sources import serp as SERP
from quillspark.sources.fixture_sql import with_views
from quillspark.sources.tables import Tables
from quillspark.suite.scans import ITEMS


def _item_lines(spark, sf) -> str:
    """One JSON line per conversation. In every seventh the questions are an object, every
    eleventh line is cut short, every thirteenth names no run."""
    docs = C.serp_documents(fx.serp_items(Tables(spark, sf)))
    c = F.col("conv_id")
    run = F.when(c % 13 != 12, F.expr(f"conv_id div {ITEMS}")).alias("run_id")
    ids = [c, run, (c % ITEMS).alias("pos")]
    line = F.when(c % 7 == 3, F.to_json(F.struct(*ids, F.struct(F.lit("none").alias("question")).alias("peopleAlsoAsk")))).otherwise(
        F.to_json(F.struct(*ids, "peopleAlsoAsk")))
    path = shared_path(spark, "serp", "items")
    cut = F.substring(line, F.lit(1), F.length(line) - 1)
    docs.select(F.when(c % 11 == 5, cut).otherwise(line).alias("value")).write.text(path)
    return path


@query("serp_items_json", with_views("paa_v") + f"""
SELECT conv_id // {ITEMS} AS run_id, CAST(conv_id % {ITEMS} AS BIGINT) AS pos,
       CASE WHEN conv_id % 7 = 3 THEN []::VARCHAR[] ELSE paa END AS paa
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id // {ITEMS} ORDER BY conv_id) AS rn FROM paa_v
      WHERE conv_id % 11 <> 5 AND conv_id % 13 <> 12) WHERE rn = 1""")
def serp_items_json(spark, sf):
    """SRC4 + S14 + G1: items as JSON lines, first sound item of a run, its questions."""
    items, _ = SERP.read_items(spark, _item_lines(spark, sf))
    return C.extract_paa(SERP.first_items(items)).select("run_id", "pos", "paa")


@query("serp_items_rejected", """
SELECT DISTINCT conv_id, CASE WHEN conv_id % 11 = 5 THEN 'not json' ELSE 'no run or place' END AS reason
FROM conversations WHERE conv_id % 11 = 5 OR conv_id % 13 = 12""")
def serp_items_rejected(spark, sf):
    """SRC4: the lines that are no items, each with its reason."""
    _, rejects = SERP.read_items(spark, _item_lines(spark, sf))
    return rejects.select(F.regexp_extract("value", r'"conv_id":(\d+)', 1).cast("long").alias("conv_id"), "reason")


def _keyword_files(spark, sf):
    """A folder of keyword files per nation: by number modulo 5 missing, empty, without
    the column, or sound; (base, wanted)."""
    t = Tables(spark, sf)
    base = shared_path(spark, "keywords", "files")
    n = F.col("s_nationkey")
    rows = t.supplier.where((n % 5 != 0) & (n % 5 != 1)).select(
        n.alias("owner"), F.col("s_suppkey").alias("seq"),
        F.concat_ws(",", F.lit('"x, y"'), F.when(F.col("s_suppkey") % 6 != 0, F.concat(F.lit('"'), "s_name", F.lit('"'))).otherwise(""), F.lit("z")).alias("value"))
    owners = t.nation.select(F.col("n_nationkey").alias("owner"))
    heads = owners.where(F.col("owner") % 5 >= 2).select(
        "owner", F.lit(-1).cast("long").alias("seq"), F.when(F.col("owner") % 5 == 2, "A,B,C").otherwise("A,Keyword,C").alias("value"))
    blank = owners.where(F.col("owner") % 5 == 1).select("owner", F.lit(0).cast("long").alias("seq"), F.lit("Keyword").alias("value"))
    (rows.unionByName(heads).unionByName(blank).repartition("owner").sortWithinPartitions("owner", "seq")
     .select("owner", "value").write.partitionBy("owner").text(base))
    return base, owners.select("owner", F.concat(F.lit(base + "/owner="), F.col("owner").cast("string")).alias("path"))


_FILES_SQL = f"""
WITH good AS (SELECT s_nationkey AS owner, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, s_name, s_suppkey
              FROM supplier WHERE s_nationkey % 5 >= 3),
kept AS (SELECT owner, pos, s_name AS keyword FROM good WHERE s_suppkey % 6 <> 0),
filled AS (SELECT n_nationkey AS owner, f.pos, f.keyword FROM nation
           JOIN (VALUES {", ".join(f"({i}, {sql_literal(k)})" for i, k in enumerate(S.FALLBACK_KEYWORDS))}) f(pos, keyword)
             ON n_nationkey NOT IN (SELECT owner FROM kept))
"""


@query("keyword_files_fallback", _FILES_SQL + """
SELECT owner, pos, keyword, 'list' AS source FROM kept UNION ALL SELECT owner, pos, keyword, 'fallback' FROM filled""")
def keyword_files_fallback(spark, sf):
    """SRC1 + SRC2: a missing, an empty and a broken file give the fallback, the others their cells."""
    base, wanted = _keyword_files(spark, sf)
    lists = K.read_keyword_files(spark, base, wanted).select("owner", "pos", "keyword")
    return K.with_fallback(lists, wanted.select("owner"), owner="owner")


@query("keyword_files_merged", _FILES_SQL + """
SELECT c_nationkey AS owner, 0 AS src_rank, c_custkey AS pos, c_name AS keyword FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT owner, 1, pos, keyword FROM kept UNION ALL SELECT owner, 1, pos, keyword FROM filled""")
def keyword_files_merged(spark, sf):
    """SRC2 + U1: own keywords first, then the file's list or the fallback."""
    own = Tables(spark, sf).customer.where(F.col("c_custkey") % 10 == 0).select(
        F.col("c_nationkey").alias("owner"), F.lit(0).alias("src_rank"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("keyword"))
    listed = keyword_files_fallback(spark, sf).select("owner", F.lit(1).alias("src_rank"), "pos", "keyword")
    return own.unionByName(listed)
