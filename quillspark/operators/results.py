"""Operators over the analysis-result log: newest per keyword (W1), as-of
cache lookup (J6), history (P2/O2, P5), cached projection (P4), daily rollup
(A4), retention (D13), chart join (J4) and result-map merges (U5).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.functions.timefmt import newer_than
from quillspark.functions.strings import prefix
from quillspark.operators.hotkeys import hot_join
from quillspark.operators.scan import asof_last_id
from quillspark.sinks.snapshots import materialize


def empty_list() -> Column:
    return F.array().cast("array<string>")


def newest_first(ts: str = "created_at", tiebreak: str = "id") -> list[Column]:
    """PostgreSQL ``ORDER BY ts DESC``: NULL times first; unique tiebreak added."""
    return [F.col(ts).desc_nulls_first(), F.col(tiebreak).desc()]


def latest_per_key(results: DataFrame, key: str = "keyword", ts: str = "created_at",
                   tiebreak: str = "id", fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Newest row per key (NULL time counts as newest, as in a DESC sort).

    The winners' ids come from an aggregate over (key, time, id) alone, which
    combines map-side; the payload is fetched by a semi join on the unique id,
    so no content passes through the aggregate.  ``fetch(ids)`` gives the rows of
    ``results`` with these ids where a source finds them before it reads their payload.
    """
    order = F.struct(F.col(ts).isNull().alias("n"), F.col(ts).alias("t"), F.col(tiebreak).alias("i"))
    win = results.groupBy(key).agg(F.max(order).alias("_m")).select(F.col("_m.i").alias("_win"))
    rows = fetch(win) if fetch else results.join(win, results[tiebreak] == F.col("_win"), "left_semi")
    return rows.select(key, *[c for c in results.columns if c != key])


def history(results: DataFrame, k: int = S.HISTORY_LIMIT) -> DataFrame:
    """The newest k results across all users (top-k, not per user)."""
    cols = ["id", "keyword", "paa_questions", "content", "created_at"]
    return results.select(*cols).orderBy(*newest_first()).limit(k)


def history_cards(results: DataFrame) -> DataFrame:
    """P5: question count, first question, 150-char preview with '...' always appended."""
    paa = F.coalesce(F.col("paa_questions"), empty_list())
    return results.select(
        "id", "keyword", F.size(paa).alias("paa_count"),
        F.get(F.col("paa_questions"), 0).alias("first_question"),
        F.concat(F.coalesce(prefix("content", S.CARD_PREVIEW_CHARS), F.lit("")), F.lit("...")).alias("preview"))


def to_cached_result(df: DataFrame) -> DataFrame:
    """Stored row -> result record served from the cache."""
    content = F.coalesce(F.col("content"), F.lit(""))
    return df.select(
        "keyword", F.coalesce(F.col("paa_questions"), empty_list()).alias("paa"),
        content.alias("content"), content.alias("draft_content"),
        F.lit("success").alias("status"), F.lit(S.CACHED_MODEL_LABEL).alias("used_model"))


def cache_lookup(requests: DataFrame, results: DataFrame, ts: str = "ts") -> DataFrame:
    """J6 batch form: each request gets the newest result of its keyword written
    strictly before the request (``hit_id`` NULL on a miss)."""
    return asof_last_id(requests, results.select("keyword", "created_at", "id"), ["keyword"],
                        ts, "created_at", "id", out="hit_id", strict=True)


def attach_hit(looked_up: DataFrame, results: DataFrame, cols: list[str]) -> DataFrame:
    """Join the payload of the matched result back by id (ids are unique).
    The looked-up rows are stored once; those of a result that many requests
    hit, or of none, are dealt over tasks."""
    r = results.select(F.col("id").alias("hit_id"), *cols)
    j = hot_join(materialize(looked_up, "looked_up"), r, ["hit_id"], "left")
    return j.select(*looked_up.columns, *r.columns[1:])


def daily_counts(results: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """A4 + F7: per day of the last ``days`` days (strictly newer than as_of - days)."""
    recent = results.filter(newer_than(F.col("created_at"), as_of, days))
    g = recent.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.count_distinct("keyword").alias("unique_keywords"))
    return g.select("total_analyses", "unique_keywords", "date",
                    F.col("total_analyses").alias("daily_count")).orderBy(F.col("date").desc())


def retain(results: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Next snapshot after deleting rows older than as_of - days (NULL times stay)."""
    old = F.col("created_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return results.filter(~F.coalesce(old, F.lit(False)))


def paa_chart(keyword_list: DataFrame, result_map: DataFrame) -> DataFrame:
    """One bar per list entry; count = #questions of a successful result, else 0.
    Only the number of questions goes through the join; a keyword that much of the
    list asks for is dealt over tasks."""
    m = result_map.select("keyword", F.col("status").alias("_st"), F.size(F.coalesce("paa", empty_list())).alias("_n"))
    j = hot_join(keyword_list, m, ["keyword"], "left")
    return j.select(
        *keyword_list.columns,
        F.when(F.col("_st") == "success", F.col("_n")).otherwise(F.lit(0)).alias("paa_count"),
        F.coalesce(F.col("_st"), F.lit("pending")).alias("status"))


def merge_result_maps(current: DataFrame, incoming: DataFrame, key: str = "keyword") -> DataFrame:
    """Map merge, an incoming entry replaces the whole current entry."""
    cols = [c for c in current.columns if c != key]
    a = current.select(key, F.struct(*cols).alias("_a"))
    b = incoming.select(key, F.struct(*cols).alias("_b"))
    j = a.join(b, key, "full_outer")
    pick = F.when(F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col("_a"))
    return j.select(key, *[pick[c].alias(c) for c in cols],
                    F.when(F.col("_b").isNotNull(), "incoming").otherwise("current").alias("origin"))


def overlay_results(current: DataFrame, refinements: DataFrame, key: str = "keyword") -> DataFrame:
    """U5 refine variant: only content and model change; PAA and keyword are kept.
    Refinements for keywords without a current entry add nothing."""
    r = refinements.select(key, F.lit(True).alias("_hit"), F.col("content").alias("_c"),
                           F.col("used_model").alias("_m"))
    j = current.join(r, key, "left")
    # Refining needs a shown result with non-empty content.
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.coalesce(F.col("content") != "", F.lit(False))
    out = [F.when(hit, F.col("_c")).otherwise(F.col("content")).alias("content")
           if c == "content" else
           F.when(hit, F.col("_m")).otherwise(F.col("used_model")).alias("used_model")
           if c == "used_model" else F.col(c) for c in current.columns]
    return j.select(*out)
