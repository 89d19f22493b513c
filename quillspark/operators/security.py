"""Row-level security and referential actions as set operations.

A policy ``USING (auth.uid() = user_id)`` over many principals at once is an
equi-join of principals and rows on the owner column; the insert check
``WITH CHECK`` splits a batch into accepted rows and rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RLS_VIOLATION = "42501"


def visible_rows(principals: DataFrame, rows: DataFrame, owner: str = "user_id") -> DataFrame:
    """F8: rows each principal may read (own rows only); others are skipped silently."""
    p = principals.select("principal_id").filter(F.col("principal_id").isNotNull()).distinct()
    r = rows.withColumnRenamed(owner, "principal_id")
    return r.join(p, "principal_id", "left_semi")


def check_owner(batch: DataFrame, owner: str = "user_id", writer: str = "writer_id") -> DataFrame:
    """a row is accepted only when its owner is the writer (a NULL owner fails)."""
    ok = F.coalesce(F.col(owner) == F.col(writer), F.lit(False))
    return batch.withColumn("accepted", ok).withColumn(
        "error_code", F.when(~ok, F.lit(RLS_VIOLATION)))


def cascade(children: DataFrame, live_parents: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """ON DELETE CASCADE — children of removed parents vanish; NULL references stay."""
    parents = live_parents.select(F.col(pk).alias("_pk")).distinct()
    kept = children.join(parents, children[fk] == F.col("_pk"), "left")
    return kept.filter(F.col("_pk").isNotNull() | F.col(fk).isNull()).drop("_pk")
