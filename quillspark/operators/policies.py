"""Row policies as data (F8, F9) and referential actions over several tables.

A policy is a row ``(table, command, rule)``; the rules are ``owner`` (the row's
owner is the caller) and ``all``. They are compiled into joins of callers and rows
on the owner column, so many callers are served by one job. As in the
database: SELECT, UPDATE and DELETE skip rows that no policy lets through without
a word; INSERT rejects them with a code; a table and command without a
policy matches nothing; the table's owner (``bypass``) is not checked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.security import RLS_VIOLATION
from quillspark.sinks.snapshots import materialize

# The policies of the application.
POLICIES = [
    ("user_usage", "SELECT", "owner"), ("user_usage", "UPDATE", "owner"), ("user_usage", "INSERT", "owner"),
    ("content_refinements", "SELECT", "owner"), ("content_refinements", "INSERT", "owner"),
    ("analysis_results", "SELECT", "all"), ("analysis_results", "INSERT", "all"),
    ("user_keywords", "SELECT", "owner"), ("user_keywords", "INSERT", "owner"), ("user_keywords", "DELETE", "owner"),
]
OWNER = "user_id"


def rules_for(table: str, command: str, policies=POLICIES) -> set[str]:
    return {rule for t, c, rule in policies if (t, c) == (table, command)}


def visible(callers: DataFrame, rows: DataFrame, table: str, policies=POLICIES, owner: str = OWNER) -> DataFrame:
    """F8 SELECT: (caller, row) for every row that a caller may read.

    ``owner`` rules are an equi-join; ``all`` gives every caller every row, so the
    rows come once, with a null caller that stands for each of them."""
    rules = rules_for(table, "SELECT", policies)
    if "all" in rules:
        return rows.withColumn("caller", F.lit(None).cast("long"))
    c = callers.select(F.col("caller")).where("caller is not null").distinct()
    if "owner" in rules:
        return rows.join(c, F.col(owner) == F.col("caller"))
    return rows.withColumn("caller", F.lit(None).cast("long")).limit(0)


def permitted(requests: DataFrame, rows: DataFrame, key: list[str], table: str, command: str, policies=POLICIES,
              owner: str = OWNER, bypass: bool = False) -> DataFrame:
    """Rows of ``requests`` (caller, key columns, ...) that hit a row which the caller may change.

    A row must be visible to be found (an UPDATE or DELETE reads it first) and the
    command's policy must let it through; requests for others are skipped silently."""
    hit = requests.join(rows.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(owner).alias("_owner")),
                        reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key]))
    if not bypass:
        for rules in (rules_for(table, "SELECT", policies), rules_for(table, command, policies)):
            if "all" not in rules:
                hit = hit.where((F.col("_owner") == F.col("caller")) if "owner" in rules else F.lit(False))
    return hit.select(requests.columns)


def update_rows(rows: DataFrame, requests: DataFrame, key: list[str], sets: dict[str, Column], table: str, order: list[str],
                policies=POLICIES, owner: str = OWNER, bypass: bool = False) -> DataFrame:
    """F8 UPDATE: next snapshot. ``sets`` are expressions over the row and the request
    (struct ``req``); of several permitted requests for a row the last by ``order`` wins."""
    ok = permitted(requests, rows, key, table, "UPDATE", policies, owner, bypass)
    others = [c for c in requests.columns if c not in key]
    last = ok.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("req"))
    j = rows.join(last, key, "left")
    return j.select(*[F.when(F.col("req").isNotNull(), sets[c]).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c)
                      if c in sets else F.col(c) for c in rows.columns])


def delete_rows(rows: DataFrame, requests: DataFrame, key: list[str], table: str, policies=POLICIES, owner: str = OWNER,
                bypass: bool = False) -> DataFrame:
    """F8 DELETE: next snapshot, without the rows of permitted requests."""
    ok = permitted(requests, rows, key, table, "DELETE", policies, owner, bypass)
    return rows.join(ok.select(*key).distinct(), key, "left_anti").select(rows.columns)


def insert_check(batch: DataFrame, table: str, policies=POLICIES, owner: str = OWNER, caller: str = "caller",
                 bypass: bool = False) -> DataFrame:
    """``accepted`` and ``error_code`` for every row of an insert. A null owner or a
    null caller fails an ``owner`` rule; ``all`` takes any writer, anonymous ones too."""
    rules = rules_for(table, "INSERT", policies)
    ok = F.lit(True) if bypass or "all" in rules else F.lit(False)
    if "owner" in rules and "all" not in rules and not bypass:
        ok = F.coalesce(F.col(owner) == F.col(caller), F.lit(False))
    return batch.withColumn("accepted", ok).withColumn("error_code", F.when(~ok, F.lit(RLS_VIOLATION)))


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    key: str = "id"


# The references of the application's tables, all ON DELETE CASCADE.
FOREIGN_KEYS = [ForeignKey("user_usage", "user_id", "users"), ForeignKey("content_refinements", "user_id", "users"),
                ForeignKey("user_keywords", "user_id", "users")]


def cascade_delete(tables: dict[str, DataFrame], deleted: dict[str, DataFrame], keys: list[ForeignKey] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """The next snapshots of all tables after ``deleted`` rows go (table -> rows with the referenced key columns).

    The references form a graph; deletions are carried along it, one level of
    references at a time, until no table loses further rows: per level one anti
    join of the children on the keys that went at the level before. References that are
    NULL stay, as in the database. Tables that refer to themselves or to each
    other in a circle come to a fixed point too; the steps are written tables,
    whose counts end the walk."""
    now, wave = dict(tables), {}
    for name, rows in deleted.items():
        columns = sorted({fk.key for fk in keys if fk.parent == name}) or rows.columns
        wave[name] = rows.select(*columns).distinct()
        now[name] = now[name].join(wave[name].dropna(), columns, "left_anti").select(tables[name].columns)
    level = 0
    while wave:
        lost: dict[str, DataFrame] = {}
        for fk in keys:
            if fk.parent in wave:
                gone = wave[fk.parent].select(F.col(fk.key).alias(fk.column)).dropna().distinct()
                hit = now[fk.child].join(gone, fk.column, "left_semi").select(tables[fk.child].columns)
                referenced = sorted({k.key for k in keys if k.parent == fk.child})
                if referenced:                     # others may refer to the rows that go
                    step = materialize(hit.select(*referenced).distinct(), f"cascade_{level}_{fk.child}")
                    if not step.isEmpty():
                        lost[fk.child] = step if fk.child not in lost else lost[fk.child].unionByName(step).distinct()
                now[fk.child] = now[fk.child].join(gone, fk.column, "left_anti").select(tables[fk.child].columns)
        wave, level = lost, level + 1
        if wave:                                   # cut the plans of a long walk
            now = {t: materialize(df, f"cascade_{level}_{t}_rows") if any(fk.child == t for fk in keys) else df for t, df in now.items()}
    return now
