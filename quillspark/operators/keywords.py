"""Keyword-list operators: list scan and fallback (SRC1, SRC2), ordered merge
and set maintenance (U1-U4), search (F3), the add-validation ladder (F12),
insert / delete against UNIQUE(user_id, keyword) (D3, D9, W3), membership
(J5), counts (A1-A3, A6) and the ``updated_at`` touch (D15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import schemas as S
from quillspark.functions.ids import key_uuid
from quillspark.functions.strings import js_is_blank, js_trim, utf16_length
from quillspark.operators.scan import global_row_number, keyed_row_number


# --------------------------------------------------------------------- sources
def read_keyword_file(spark: SparkSession, path: str, fmt: str = "csv",
                      column: str = "Keyword") -> DataFrame:
    """SRC1 from a file with a header row: keep ``column`` in file order.

    Only the named column is read (the rest of the header is ignored).  Spark
    reads larger files first, so the position is the rank by file path, place
    of the split in its file and row of the split.
    """
    r = spark.read.option("header", True)
    if fmt == "csv":
        # Header names the columns; every cell stays a string (no inference pass).
        df = r.option("inferSchema", False).csv(path)
    else:
        df = r.format(fmt).load(path)
    df = df.select(column, F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_at")).withColumn("_row", F.monotonically_increasing_id())
    ranked = global_row_number(df, [F.col("_file"), F.col("_at"), F.col("_row")], "pos")
    return keyword_list(ranked.select(column, (F.col("pos") - 1).alias("pos")), column, "pos")


# A comma outside of double quotes.
CELL = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_keyword_files(spark: SparkSession, base: str, wanted: DataFrame, owner: str = "owner", path: str = "path",
                       column: str = "Keyword") -> DataFrame:
    """SRC1 and SRC2 over many files: (owner, pos, keyword, status) for ``wanted`` (owner, path).

    A list is a folder below ``base`` whose CSV files each begin with a header row; the
    cells of ``column`` are kept in file order, falsy ones dropped. A wanted path without
    any file gives the sentinel row; one whose files are empty or lack the column gives no
    row, so that ``with_fallback`` takes over, and fails no other list. Which files
    exist comes from a listing joined to ``wanted``, not from a look at each path."""
    def folder(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(c, "/[^/]*$", ""), "^file:/+", "/")
    present = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
               .select(folder("path").alias(path)).distinct())
    asked = wanted.select(owner, F.regexp_replace(path, "^file:/+", "/").alias(path))
    missing = asked.join(present, path, "left_anti").select(
        owner, F.lit(0).cast("long").alias("pos"), F.lit(S.MISSING_FILE_SENTINEL).alias("keyword"), F.lit("missing").alias("status"))
    lines = (spark.read.option("recursiveFileLookup", "true").text(base)
             .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
             .withColumn("_row", F.monotonically_increasing_id()).withColumn(path, folder("_file")))
    place = F.struct("_at", "_row")

    def cells(c: str) -> Column:
        return F.transform(F.split(c, CELL, -1), lambda x: F.replace(F.regexp_replace(x, '^\\s*"|"\\s*$', ""), F.lit('""'), F.lit('"')))
    header = lines.groupBy("_file").agg(F.min(place).alias("_first"), F.min_by("value", place).alias("_header"))
    at = F.array_position(cells("_header"), column)
    found = (lines.join(header, "_file").where((place != F.col("_first")) & (at > 0)).join(asked, path)
             .select(owner, "_file", "_at", "_row", F.get(cells("value"), (at - 1).cast("int")).alias("keyword")))
    ranked = keyed_row_number(found, [owner], [F.col("_file"), F.col("_at"), F.col("_row")], "pos")
    return missing.unionByName(ranked.where("keyword is not null and keyword <> ''")
                               .select(owner, (F.col("pos") - 1).alias("pos"), "keyword", F.lit("file").alias("status")))


def keyword_list(df: DataFrame, column: str = "Keyword", pos: str = "pos") -> DataFrame:
    """SRC1: (pos, keyword), falsy cells dropped (NULL, '', numeric 0); no trim, no dedup."""
    c = F.col(column)
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        keep = c.isNotNull() & (c != "")
    else:
        keep = c.isNotNull() & (c != 0)
    rest = [x for x in df.columns if x not in (column, pos)]
    return df.filter(keep).select(*rest, F.col(pos).alias("pos"), c.cast("string").alias("keyword"))


def with_fallback(lists: DataFrame, owners: DataFrame, owner: str = "user_id",
                  fallback: list[str] | None = None) -> DataFrame:
    """SRC2 per owner: keep an owner's list unless it is empty or its first entry
    starts with 'Error' (the missing-file sentinel); then use the fallback list.

    ``lists`` has (owner, pos, keyword).  The fallback is a fixed literal array
    exploded per failing owner: no join against a fallback table.
    """
    fb = fallback if fallback is not None else S.FALLBACK_KEYWORDS
    stats = lists.groupBy(owner).agg(
        F.min_by("keyword", "pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    o = owners.select(owner).join(stats, owner, "left")
    failed = F.col("_n").isNull() | F.coalesce(F.startswith("_first", F.lit("Error")), F.lit(False))
    bad = o.filter(failed).select(owner)
    good = o.filter(~failed).select(owner)
    kept = lists.join(good, owner, "left_semi").select(
        owner, "pos", "keyword", F.lit("list").alias("source"))
    filled = bad.select(owner, F.posexplode(F.array(*[F.lit(k) for k in fb])).alias("pos", "keyword"))
    filled = filled.select(owner, F.col("pos").cast("long").alias("pos"), "keyword",
                           F.lit("fallback").alias("source"))
    return kept.unionByName(filled)


# -------------------------------------------------------------------- set ops
def merged_entries(custom: DataFrame, listed: DataFrame) -> DataFrame:
    """The entries of ``merge_lists`` in no order (for counts)."""
    a = custom.select(F.lit(0).alias("src_rank"), "user_id", "keyword", "created_at",
                      F.lit(None).cast("long").alias("pos"))
    b = listed.select(F.lit(1).alias("src_rank"), F.lit(None).cast("long").alias("user_id"),
                      "keyword", F.lit(None).cast("timestamp_ntz").alias("created_at"),
                      F.col("pos").cast("long").alias("pos"))
    return a.unionByName(b)


def merge_lists(custom: DataFrame, listed: DataFrame) -> DataFrame:
    """Custom keywords first (newest first per user, NULL times first as in
    PostgreSQL), then the listed ones in file order; duplicates kept.
    Columns: src_rank, user_id, keyword, created_at, pos."""
    # Listed entries keep file order (pos); the keyword only breaks ties of equal times.
    return merged_entries(custom, listed).orderBy(
        "src_rank", "user_id", F.col("created_at").desc_nulls_first(), "pos", "keyword")


def distinct_set(df: DataFrame, cols: list[str]) -> DataFrame:
    """U2."""
    return df.select(*cols).distinct()


def update_set(current: DataFrame, adds: DataFrame, removes: DataFrame, cols: list[str]) -> DataFrame:
    """(current ∪ adds) − removes, as a set."""
    u = current.select(*cols).unionByName(adds.select(*cols)).distinct()
    return u.join(removes.select(*cols).distinct(), cols, "left_anti")


def prepend_missing(list_df: DataFrame, incoming: DataFrame, ts: str = "created_at") -> DataFrame:
    """U4: keywords of ``incoming`` absent from the list go in front, once each.

    A keyword is put in front when it first comes, so the latest newcomer
    stands first: order by (src_rank, added_at descending, keyword, pos).
    """
    first = incoming.groupBy("keyword").agg(F.min(ts).alias("added_at"))
    missing = first.join(list_df.select("keyword"), "keyword", "left_anti")
    a = missing.select(F.lit(0).alias("src_rank"), "keyword", F.lit(None).cast("long").alias("pos"), "added_at")
    b = list_df.select(F.lit(1).alias("src_rank"), "keyword", F.col("pos").cast("long").alias("pos"),
                       F.lit(None).cast(incoming.schema[ts].dataType).alias("added_at"))
    return a.unionByName(b).orderBy("src_rank", F.col("added_at").desc_nulls_first(), "pos", "keyword")


# ----------------------------------------------------------------- predicates
def search(df: DataFrame, q: str, column: str = "keyword") -> DataFrame:
    """case-insensitive literal substring; an empty query keeps every row."""
    return df.filter(F.contains(F.lower(F.col(column)), F.lower(F.lit(q))))


def first_per_key(batch: DataFrame, keys: list[str], ts: str, tiebreak: str,
                  out: str = "is_first") -> DataFrame:
    """The earliest row per key wins (NULL times first, as in a window).

    The winner per key is a map-side combined aggregate over (time, id) of any
    type; it is marked by a join on the unique id, so rows of a hot key never
    meet in one task.
    """
    win = (batch.groupBy(*keys).agg(F.min(F.struct(F.col(ts).alias("t"), F.col(tiebreak).alias("i"))).alias("_m"))
           .select(F.col("_m.i").alias(tiebreak), F.lit(True).alias("_win")))
    return batch.join(win, tiebreak, "left").withColumn(out, F.col("_win").isNotNull()).drop("_win")


def validate_adds(adds: DataFrame, usage: DataFrame, existing: DataFrame) -> DataFrame:
    """first failing rule wins — login, premium, empty, length, duplicate.

    Duplicates are checked against the table and against earlier adds of the
    batch (an earlier identical add passed the same per-row rules, so it was
    inserted first).  Output adds ``keyword_trimmed``, ``outcome``, ``message``.
    """
    # The first add per keyword is found on the bare adds, before any other join.
    a = first_per_key(adds.withColumn("keyword_trimmed", js_trim(F.col("keyword"))),
                      ["user_id", "keyword_trimmed"], "ts", "add_id")
    prem = usage.select("user_id", F.col("is_premium").alias("_premium"))
    a = a.join(prem, "user_id", "left")
    ex = existing.select("user_id", F.col("keyword").alias("keyword_trimmed"),
                         F.lit(True).alias("_exists"))
    a = a.join(ex, ["user_id", "keyword_trimmed"], "left")
    outcome = (F.when(F.col("user_id").isNull(), "login")
               .when(~F.coalesce(F.col("_premium"), F.lit(False)), "not_premium")
               .when(F.col("keyword_trimmed") == "", "empty")
               .when(utf16_length(F.col("keyword_trimmed")) > S.MAX_KEYWORD_LENGTH, "too_long")
               .when(F.coalesce(F.col("_exists"), F.lit(False)) | ~F.col("is_first"), "duplicate")
               .otherwise("ok"))
    message = (F.when(outcome == "login", S.MSG_LOGIN_REQUIRED)
               .when(outcome == "not_premium", S.MSG_NOT_PREMIUM)
               .when(outcome == "empty", S.MSG_EMPTY_KEYWORD)
               .when(outcome == "too_long", S.MSG_TOO_LONG)
               .when(outcome == "duplicate", S.MSG_DUPLICATE)
               .otherwise(S.MSG_ADDED))
    return (a.withColumn("outcome", outcome).withColumn("message", message)
             .withColumn("in_custom", F.coalesce(F.col("_exists"), F.lit(False)))
             .drop("_premium", "_exists", "is_first"))


def validate_adds_client(adds: DataFrame, usage: DataFrame, existing: DataFrame,
                         listed: DataFrame) -> DataFrame:
    """F12 with the dashboard's own checks in front.

    Blank input is ignored without a call; a keyword already in the user's
    merged list (own keywords and the listed ones) or added earlier in the
    session is a duplicate before the server is asked.  An earlier identical
    add was only put in the list if the server accepted it, so within the
    batch a later add is a duplicate exactly when the shared per-row server
    rules (login, premium, length) pass.
    """
    v = validate_adds(adds, usage, existing)
    lst = listed.select(F.col("keyword").alias("keyword_trimmed")).distinct().withColumn("_listed", F.lit(True))
    v = v.join(lst, "keyword_trimmed", "left")
    # In the merged list: a listed keyword, one of the user's own, or an
    # earlier add of the batch that the server accepted (server outcome
    # 'duplicate' already means exactly that).
    client_dup = (F.coalesce(F.col("_listed"), F.lit(False)) | F.col("in_custom")
                  | (F.col("outcome") == "duplicate"))
    outcome = (F.when(F.col("keyword").isNull() | js_is_blank(F.col("keyword")), "ignored")
               .when(client_dup, "duplicate").otherwise(F.col("outcome")))
    v = v.withColumn("_client", outcome)
    message = (F.when(F.col("_client") == "ignored", F.lit(None).cast("string"))
               .when(F.col("_client") == "duplicate", F.lit(S.MSG_DUPLICATE)).otherwise(F.col("message")))
    return (v.withColumn("message", message).withColumn("outcome", F.col("_client"))
             .drop("_listed", "_client"))


def insert_keywords(existing: DataFrame, validated: DataFrame) -> DataFrame:
    """D3: next snapshot = existing rows + accepted adds (created_at = add time).
    Row ids come from the (user_id, keyword) key, so a retried write repeats them."""
    new = validated.filter(F.col("outcome") == "ok").select(
        "user_id", F.col("keyword_trimmed").alias("keyword"), F.col("ts").alias("created_at"))
    rows = existing.select("user_id", "keyword", "created_at").unionByName(new)
    return rows.select(key_uuid("user_id", "keyword").alias("id"), "user_id", "keyword", "created_at")


def delete_keywords(existing: DataFrame, deletes: DataFrame) -> DataFrame:
    """Remove (user_id, keyword) pairs, keyword compared untrimmed; absent is fine."""
    d = deletes.filter(F.col("user_id").isNotNull()).select("user_id", "keyword")
    return existing.join(d, ["user_id", "keyword"], "left_anti")


def mark_custom(entries: DataFrame, custom: DataFrame) -> DataFrame:
    """Existence flag of (user_id, keyword) in the custom set."""
    c = custom.select("user_id", "keyword").distinct().withColumn("_hit", F.lit(True))
    j = entries.join(c, ["user_id", "keyword"], "left")
    return j.withColumn("is_custom", F.col("_hit").isNotNull()).drop("_hit")


def touch(existing: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Rows hit by an UPDATE get ``updated_at = as_of``; others keep theirs."""
    u = updates.select("user_id", "keyword").distinct().withColumn("_hit", F.lit(True))
    j = existing.join(u, ["user_id", "keyword"], "left")
    return j.withColumn("updated_at", F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))).drop("_hit")


# ---------------------------------------------------------------- aggregates
def count_all(df: DataFrame, label: str) -> DataFrame:
    """A1."""
    return df.agg(F.count(F.lit(1)).alias("initial_count")).select(
        F.lit(label).alias("message"), "initial_count")


def per_user_counts(kw: DataFrame) -> DataFrame:
    """A2."""
    return kw.groupBy("user_id").agg(F.count(F.lit(1)).alias("keywords_per_user"))


def keyword_stats(kw: DataFrame) -> DataFrame:
    """A3 as published: the outer COUNT(*) runs over the per-user groups, so
    ``total_keywords`` counts users; ``sum_keywords`` gives the row total."""
    g = per_user_counts(kw)
    return g.agg(F.count(F.lit(1)).alias("total_keywords"),
                 F.count_distinct("user_id").alias("unique_users"),
                 F.avg("keywords_per_user").alias("avg_per_user"),
                 F.sum("keywords_per_user").alias("sum_keywords"))


def source_counts(merged: DataFrame) -> DataFrame:
    """Entries per source plus the grand total (rollup row has source NULL)."""
    return merged.rollup("source").agg(F.count(F.lit(1)).alias("n_keywords"))

