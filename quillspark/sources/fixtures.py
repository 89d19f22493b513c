"""Application-shaped inputs derived from the driver's tables.

Each function returns a lazy DataFrame; nothing is materialised but the narrow
rows of ``join_results`` where two texts are joined to them.  The same
shapes are written as SQL CTEs in ``fixture_sql`` for the DuckDB oracles, so
the two sides are built independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.hotkeys import join_pair
from quillspark.sources.tables import Tables

# Fixed fixture constants (FIXTURES.md §3).
REQUEST_START = "2024-01-16 00:00:00"   # date of the cache snapshot
CHUNK_BYTES = 256        # streaming chunks are cut from UTF-8 bytes
ROWS_PER_TASK = 1_000_000    # narrow rows that one task sorts or groups


def request_start() -> Column:
    return F.lit(REQUEST_START).cast("timestamp_ntz")


def _at_least_one(df: DataFrame, count: Column) -> Column:
    """A table's own count as a scalar subquery, for mapping ids onto all its rows."""
    return F.greatest(df.agg(count.alias("n")).scalar(), F.lit(1))


def doc_count(t: Tables) -> Column:
    return _at_least_one(t.documents, F.count(F.lit(1)))


def run_count(t: Tables) -> Column:
    """Crawl runs are the conversations."""
    return _at_least_one(t.conversations, F.count_distinct("conv_id"))


def keyword_count(t: Tables) -> Column:
    """Result keywords per event type: one per ten customers."""
    return _at_least_one(t.customer, F.floor(F.count(F.lit(1)) / 10))


def result_keyword(t: Tables) -> Column:
    return F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") % keyword_count(t)).cast("string"))


def users(t: Tables) -> DataFrame:
    c = t.customer
    seg = F.col("c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(seg == "BUILDING", "admin").when(seg == "MACHINERY", "test")
         .otherwise("regular").alias("role"))


def admin_emails(t: Tables) -> DataFrame:
    """The admin allow-list as a table (one column ``email``)."""
    return users(t).filter(F.col("role") == "admin").select("email")


def test_emails(t: Tables) -> DataFrame:
    return users(t).filter(F.col("role") == "test").select("email")


def usage(t: Tables) -> DataFrame:
    u = users(t)
    o = (t.orders.groupBy("o_custkey")
         .agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_at"),
              F.max("o_orderdate").alias("last_at")))
    j = u.filter(F.col("id") % 5 != 0).join(o, u.id == o.o_custkey, "left")
    return j.select(
        F.col("id").alias("user_id"), "email",
        F.coalesce("n", F.lit(0)).alias("usage_count"),
        F.when(F.col("role") == "admin", F.lit(999999)).otherwise(F.lit(10)).alias("max_usage"),
        ((F.col("role") == "admin") | (F.col("id") % 11 == 0)).alias("is_premium"),
        F.col("first_at").alias("created_at"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("last_at")).alias("last_used_at"))


def _tasks(df: DataFrame) -> int:
    """Tasks for a step over ``df``: one per ROWS_PER_TASK rows, the shuffle parallelism at least.
    A number given outright is not merged again into tasks of a size in compressed bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_TASK))


def keywords(t: Tables) -> DataFrame:
    """Lies in tasks by user, so the group by (user, keyword) and joins by user move no rows."""
    n = _tasks(t.lineitem)
    li = t.lineitem.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    p = t.part.select("p_partkey", "p_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select("l_partkey", "o_custkey", "o_orderdate").repartition(n, "l_partkey")
    named = j.join(p, j.l_partkey == p.p_partkey).select("o_custkey", "o_orderdate", "p_name").repartition(n, "o_custkey")
    return (named.groupBy(F.col("o_custkey").alias("user_id"), F.col("p_name").alias("keyword"))
            .agg(F.min("o_orderdate").alias("created_at")))


def result_log(t: Tables) -> DataFrame:
    """The result log without its texts: (id, keyword, doc_id, paa_conv_id, created_at)."""
    e = t.events.select("event_id", "event_type", "user_id", "ts")
    # Results take their texts from all documents, their questions from all runs.
    return e.select(
        F.col("event_id").alias("id"),
        result_keyword(t).alias("keyword"),
        (F.col("event_id") % doc_count(t)).alias("doc_id"),
        (F.col("event_id") % run_count(t)).alias("paa_conv_id"),
        F.col("ts").alias("created_at"))


def _wanted(t: Tables, ids: DataFrame | None) -> DataFrame:
    """The log's rows, or those whose id is in ``ids`` (one column): texts are joined to them only."""
    log = result_log(t)
    return log if ids is None else log.join(ids.select(F.col(ids.columns[0]).alias("_wanted")), F.col("id") == F.col("_wanted"), "left_semi")


def _documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text", "source")


def _questions(t: Tables) -> DataFrame:
    return paa_runs(t).select(F.col("conv_id").alias("paa_conv_id"), F.col("paa").alias("paa_questions"))


def _with_content(t: Tables, log: DataFrame) -> DataFrame:
    """``content`` in place of ``doc_id``."""
    return _content(log.join(_documents(t), "doc_id", "left"))


def _content(j: DataFrame) -> DataFrame:
    """``content`` in place of ``doc_id`` and the document's columns."""
    m8, m4 = F.col("id") % 8, F.col("id") % 4
    nl = F.lit("\n")
    content = (F.when(m8 == 6, F.lit(None).cast("string"))
               .when(m8 == 2, F.lit(""))
               .when(m4 == 0, F.concat(F.lit("## "), F.col("source"), nl, F.lit("| a | b |"), nl,
                                       F.lit("| --- | --- |"), nl, F.col("text")))
               .when(m4 == 1, F.concat(F.lit("# "), F.col("text")))
               .otherwise(F.col("text")))
    return j.withColumn("content", content).drop("doc_id", "text", "source")


def _with_questions(t: Tables, log: DataFrame) -> DataFrame:
    """``paa_questions`` in place of ``paa_conv_id`` (NULL when the run does not exist)."""
    return log.join(_questions(t), "paa_conv_id", "left").drop("paa_conv_id")


def results(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Append log of analysis results (no user column, keyword not unique); with
    ``ids``, the rows that have one of these ids."""
    return _with_content(t, _wanted(t, ids)).select("id", "keyword", "content", "paa_conv_id", "created_at")


def join_results(t: Tables, rows: DataFrame, on: str, how: str = "inner", cols: tuple[str, ...] = ("content",)) -> DataFrame:
    """``rows`` joined with the ``cols`` (content, paa_questions) of ``results_full`` by
    its id: as ``rows.join(results_full(t)..., on, how)``, but rows and log meet before
    any text is joined, so a text moves for the rows that get it and no further. Where
    both are wanted, the rows' ids are stored once and the questions move once per
    document and run that meet, not once per row."""
    log = result_log(t).select(F.col("id").alias("_id"), "doc_id", "paa_conv_id")
    j = rows.join(log, F.col(on) == F.col("_id"), how).withColumnRenamed("_id", "id")
    if {"paa_questions", "content"} <= {*cols}:
        return _content(join_pair(j, _questions(t), "paa_conv_id", _documents(t), "doc_id")).select(*rows.columns, *cols)
    j = _with_questions(t, j) if "paa_questions" in cols else j.drop("paa_conv_id")
    j = _with_content(t, j) if "content" in cols else j.drop("doc_id")
    return j.select(*rows.columns, *cols)


def serp_items(t: Tables) -> DataFrame:
    """One PAA entry per row: (conv_id, turn, question, title, text, query)."""
    c = t.conversations
    m = F.col("turn") % 5
    s = F.lit(None).cast("string")
    return c.select(
        "conv_id", "turn",
        F.when(m == 0, F.col("text")).when(m == 2, F.lit("")).when(m == 4, F.lit("   "))
         .otherwise(s).alias("question"),
        F.when(m.isin(1, 4), F.col("text")).otherwise(s).alias("title"),
        F.when(m == 2, F.col("text")).otherwise(s).alias("text"),
        F.when(m == 3, F.col("text")).otherwise(s).alias("query"))


def requests(t: Tables) -> DataFrame:
    e = t.events
    eid = F.col("event_id")
    return e.select(
        eid.alias("request_id"),
        F.when(eid % 30 == 0, F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("user_id"),
        "ts",
        F.when(eid % 50 == 1, F.lit(""))
         .otherwise(result_keyword(t)).alias("keyword"),
        F.when(eid % 3 == 0, F.lit(None).cast("string")).when(eid % 3 == 1, F.lit(""))
         .otherwise(F.lit("gemini-2.5-flash-lite")).alias("selected_model"),
        F.when(eid % 4 == 0, F.lit("casual tone")).otherwise(F.lit(None).cast("string")).alias("custom_prompt"),
        (eid % 5 == 0).alias("force_refresh"))


def result_snapshot(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Results written before the snapshot date."""
    return results(t, ids).filter(F.col("created_at") < request_start())


def chunks(t: Tables, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """documents.text cut into numbered pieces of its UTF-8 bytes."""
    d = t.documents.select("doc_id", F.encode("text", "UTF-8").alias("b"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("b") / F.lit(chunk_bytes)).cast("int"))
    x = d.select("doc_id", "b", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return x.select(
        F.col("doc_id").alias("request_id"), F.col("chunk_no").cast("long").alias("chunk_no"),
        F.substring("b", F.col("chunk_no") * chunk_bytes + 1, chunk_bytes).alias("chunk"),
        (F.col("chunk_no") == F.col("n") - 1).alias("is_last"))


def paa_runs(t: Tables) -> DataFrame:
    """Question list of every SERP run."""
    from quillspark.operators.content import extract_paa, serp_documents
    return extract_paa(serp_documents(serp_items(t))).select("conv_id", "paa")


def results_full(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """results_v with its question list (NULL when the run does not exist)."""
    return _with_content(t, _with_questions(t, _wanted(t, ids))).select(
        "id", "keyword", "paa_questions", "content", "created_at")


def snapshot_full(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    return results_full(t, ids).filter(F.col("created_at") < request_start())


def keyword_adds(t: Tables) -> DataFrame:
    """Keyword add / delete requests: exact names, padded names (U+3000), blanks,
    over-long names and result keywords; every 30th has no signed-in user."""
    e = t.events.select("event_id", "ts", "user_id", "event_type")
    p = t.part.select("p_partkey", "p_name")
    j = e.join(p, p.p_partkey == e.user_id, "left")
    m = F.col("event_id") % 6
    name = F.col("p_name")
    kw = (F.when(m == 0, name)
          .when(m == 1, F.concat(F.lit("  "), name, F.lit("　")))
          .when(m == 2, F.lit("\t "))
          .when(m == 3, F.repeat(F.concat(name, F.lit(" ")), 20))
          .otherwise(result_keyword(t)))
    return j.select(
        F.col("event_id").alias("add_id"),
        F.when(F.col("event_id") % 30 == 0, F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("user_id"),
        "ts", kw.alias("keyword"))


def live_users(t: Tables) -> DataFrame:
    """Users that still exist (every 17th account was deleted)."""
    return users(t).filter(F.col("id") % 17 != 0)


def limit_inputs(t: Tables) -> DataFrame:
    """Text typed into the max-usage field: ' 69}', '69}' or '{"k": 69}'."""
    e = t.events.select("event_id", "user_id", "ts", "event_type", "value", "props")
    m = F.col("event_id") % 3
    raw = (F.when(m == 0, F.substr("props", F.lit(6)))
           .when(m == 1, F.col("props")).otherwise(F.substr("props", F.lit(7))))
    return e.withColumn("raw_limit", raw)


def limit_changes(t: Tables) -> DataFrame:
    """Admin edits of (max_usage, is_premium), one per purchase event."""
    from quillspark.functions.strings import parse_int_or_zero
    e = limit_inputs(t).filter(F.col("event_type") == "purchase")
    return e.select(F.col("event_id").alias("change_id"), "user_id", "ts",
                    parse_int_or_zero(F.col("raw_limit")).alias("max_usage"),
                    (F.col("value") > 50).alias("is_premium"))


def signup_user_ids(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "signup").select("user_id").distinct()


def signups(t: Tables) -> DataFrame:
    """New accounts (users with a signup event); every third signs up with a new email."""
    ids = signup_user_ids(t).withColumnRenamed("user_id", "id")
    u = users(t).join(ids, "id", "left_semi")
    return u.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("new-"), F.col("email")))
                    .otherwise(F.col("email")).alias("email"))
