"""Usage / quota operators: predicates (F5, F6), entitlement (J7), quota
admission (W2), reports (J1, G13, O3), single-row contract (F10), and the
write operators on ``user_usage`` (D4-D8, D10-D12) as snapshot functions
``(current, changes) -> next``.

Every per-user step is keyed by ``user_id``; Spark keeps one hash
partitioning on it across the join, the admission scan and the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.functions.strings import ratio_label
from quillspark.functions.timefmt import display_or_never
from quillspark.operators.hotkeys import hot_join
from quillspark.operators.scan import keyed_row_number

USAGE_COLS = ["user_id", "email", "usage_count", "max_usage", "is_premium", "created_at", "last_used_at"]


def exceeded(count: Column, limit: Column, premium: Column) -> Column:
    """quota exceeded ⇔ count >= max AND NOT premium."""
    return (count >= limit) & ~premium


def at_limit(count: Column, limit: Column) -> Column:
    """display flag, premium ignored."""
    return count >= limit


def in_list(df: DataFrame, col: str, members: DataFrame, member_col: str = "email",
            out: str = "is_member") -> DataFrame:
    """Membership in an allow-list table, as an existence (left) join."""
    m = members.select(F.col(member_col).alias("_m")).distinct().withColumn("_in_list", F.lit(True))
    j = df.join(m, df[col] == m["_m"], "left")
    return j.withColumn(out, F.coalesce(F.col("_in_list"), F.lit(False))).drop("_m", "_in_list")


def not_in(df: DataFrame, col: str, other: DataFrame, other_col: str) -> DataFrame:
    """SQL ``col NOT IN (SELECT other_col ...)`` with its NULL rules, join-based.

    A NULL in the subquery empties the result; a NULL probe value qualifies
    only when the subquery is empty.  The anti join shuffles on the key (no
    forced broadcast, no nested loop); the NULL rules are EXISTS subqueries.
    """
    o = other.select(F.col(other_col).alias("_k"))
    has_null, has_rows = o.filter(F.col("_k").isNull()).exists(), o.exists()
    kept = df.join(o.filter(F.col("_k").isNotNull()), df[col] == F.col("_k"), "left_anti")
    return kept.filter(~has_null).filter(F.col(col).isNotNull() | ~has_rows)


def admin_report(usage: DataFrame) -> DataFrame:
    """Email, counts, at-limit flag, membership label, last use or 'never'."""
    return usage.select(
        "user_id", "email", "usage_count", "max_usage",
        at_limit(F.col("usage_count"), F.col("max_usage")).alias("at_limit"),
        F.when(F.col("is_premium"), S.PREMIUM_LABEL).otherwise(S.REGULAR_LABEL).alias("membership"),
        display_or_never(F.col("last_used_at")).alias("last_used"))


def recent_top(usage: DataFrame, k: int = S.RECENT_USAGE_LIMIT) -> DataFrame:
    """O3: top k by last use, NULLs first as PostgreSQL sorts DESC; user_id breaks ties."""
    return (usage.select("user_id", "email", "usage_count", "max_usage", "is_premium", "last_used_at")
            .orderBy(F.col("last_used_at").desc_nulls_first(), F.col("user_id")).limit(k))


def usage_report(users: DataFrame, usage: DataFrame, admins: DataFrame, testers: DataFrame) -> DataFrame:
    """J1 + O4: every user with their usage row (if any), account type, rank order."""
    u = in_list(in_list(users.select("id", "email"), "email", admins, out="_admin"),
                "email", testers, out="_test")
    j = u.join(usage.select(F.col("user_id").alias("id"), "usage_count", "max_usage", "is_premium",
                            "created_at"), "id", "left")
    rank = F.when(F.col("_admin"), 1).when(F.col("_test"), 2).otherwise(3)
    label = (F.when(F.col("_admin"), S.REPORT_LABEL_ADMIN).when(F.col("_test"), S.REPORT_LABEL_TEST)
             .otherwise(S.REPORT_LABEL_OTHER))
    # The rank has three values; a range sort on it alone would put nearly all
    # users (rank 3) in one partition.  Order inside a rank is free, so the
    # email spreads the range partitions.
    return j.select("email", "usage_count", "max_usage", "is_premium", label.alias("account_type"),
                    "created_at", rank.alias("_rank")).orderBy("_rank", "email").drop("_rank")


def single(keys: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """F10 ``.single()``: absent (tolerated), one (value returned) or many (error)."""
    g = table.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.any_value(value).alias("_v"))
    j = keys.select(key).distinct().join(g, key, "left")
    n = F.coalesce(F.col("n_rows"), F.lit(0))
    return j.select(key, n.alias("n_rows"),
                    F.when(n == 0, "absent").when(n == 1, "one").otherwise("many").alias("status"),
                    F.when(n == 1, F.col("_v")).alias(value))


def entitle(requests: DataFrame, usage: DataFrame) -> DataFrame:
    """Each request with its user's usage row (left join on user_id); a user with much
    of the requests, and requests without a user, are dealt over tasks."""
    u = usage.select("user_id", "usage_count", "max_usage", "is_premium")
    j = hot_join(requests, u, ["user_id"], "left")
    return j.withColumn("has_usage", F.col("max_usage").isNotNull()).withColumn(
        "exceeded", F.coalesce(exceeded(F.col("usage_count"), F.col("max_usage"), F.col("is_premium")),
                               F.lit(False)))


def admit(requests: DataFrame, usage: DataFrame, ts: str = "ts", tiebreak: str = "request_id") -> DataFrame:
    """Sequential quota admission per user, in (ts, id) order, in closed form.

    Requests of users with a usage row are numbered per user (skew-safe
    row number); a non-premium user is admitted while
    ``usage_count + admitted_before < max_usage``, so the first
    ``max - usage_count`` requests pass and the rest are refused.
    Adds rn, usage_before, admitted, usage_after and the ``n/max`` label.
    """
    u = usage.select("user_id", "usage_count", "max_usage", "is_premium")
    j = requests.join(u, "user_id", "inner")
    n = keyed_row_number(j, ["user_id"], [F.col(ts), F.col(tiebreak)], "rn")
    prem = F.coalesce(F.col("is_premium"), F.lit(False))
    room = F.greatest(F.col("max_usage") - F.col("usage_count"), F.lit(0)).cast("long")
    before_n = F.when(prem, F.col("rn") - 1).otherwise(F.least(F.col("rn") - 1, room))
    before = (F.col("usage_count") + before_n).cast("long")
    ok = prem | (before < F.col("max_usage"))
    return (n.withColumn("usage_before", before)
             .withColumn("admitted", ok)
             .withColumn("usage_after", before + F.when(ok, 1).otherwise(0))
             .withColumn("label", ratio_label(F.col("usage_before"), F.col("max_usage"))))


def charge(usage: DataFrame, admitted: DataFrame, ts: str = "ts") -> DataFrame:
    """Fold admissions into the next usage snapshot: count + #admitted,
    last_used_at = latest admitted request time (kept when none)."""
    g = (admitted.filter(F.col("admitted")).groupBy("user_id")
         .agg(F.count(F.lit(1)).alias("_add"), F.max(ts).alias("_last")))
    j = usage.join(g, "user_id", "left")
    return j.select(*[
        (F.col("usage_count") + F.coalesce(F.col("_add"), F.lit(0))).cast("long").alias("usage_count")
        if c == "usage_count" else
        F.coalesce(F.col("_last"), F.col("last_used_at")).alias("last_used_at")
        if c == "last_used_at" else F.col(c) for c in usage.columns])


def ensure(usage: DataFrame, users: DataFrame, admins: DataFrame | None, as_of: Column) -> DataFrame:
    """Create the missing usage rows of ``users`` (id, email).  With an
    admin list the route's rule applies (admin: 999999 + premium); without
    one, the pipeline's (10, not premium)."""
    missing = users.select(F.col("id").alias("user_id"), "email").distinct().join(
        usage.select("user_id"), "user_id", "left_anti")
    if admins is not None:
        missing = in_list(missing, "email", admins, out="_admin")
    else:
        missing = missing.withColumn("_admin", F.lit(False))
    new = missing.select(
        "user_id", "email", F.lit(0).cast("long").alias("usage_count"),
        F.when(F.col("_admin"), S.ADMIN_MAX_USAGE).otherwise(S.DEFAULT_MAX_USAGE).alias("max_usage"),
        F.col("_admin").alias("is_premium"), as_of.alias("created_at"),
        F.lit(None).cast(usage.schema["last_used_at"].dataType).alias("last_used_at"))
    return usage.select(*USAGE_COLS).unionByName(new.select(*USAGE_COLS))


def set_limits(usage: DataFrame, changes: DataFrame, ts: str = "ts") -> DataFrame:
    """Admin edits of (max_usage, is_premium); the last change per user wins.
    A limit that the INTEGER column can't hold is refused, the edit has no effect."""
    ok = changes.filter(F.col("max_usage").between(-2**31, 2**31 - 1))
    # Winner per user by (ts, change_id); its values come back by the unique change id.
    win = ok.groupBy("user_id").agg(F.max(F.struct(ts, "change_id")).alias("_w")).select(F.col("_w.change_id").alias("change_id"))
    last = ok.join(win, "change_id", "left_semi").select(
        "user_id", F.struct(F.col("max_usage").cast("int").alias("max_usage"), "is_premium").alias("_c"))
    j = usage.join(last, "user_id", "left")
    hit = F.col("_c").isNotNull()
    return j.select(*[
        F.when(hit, F.col("_c.max_usage")).otherwise(F.col("max_usage")).alias("max_usage")
        if c == "max_usage" else
        F.when(hit, F.col("_c.is_premium")).otherwise(F.col("is_premium")).alias("is_premium")
        if c == "is_premium" else F.col(c) for c in usage.columns])


def reset(usage: DataFrame, chosen: DataFrame) -> DataFrame:
    """usage_count = 0 for the chosen users; other columns kept."""
    c = chosen.select("user_id").distinct().withColumn("_hit", F.lit(True))
    j = usage.join(c, "user_id", "left")
    return j.withColumn("usage_count", F.when(F.col("_hit"), F.lit(0).cast("long"))
                        .otherwise(F.col("usage_count"))).drop("_hit")


def upgrade(usage: DataFrame, emails: DataFrame) -> DataFrame:
    """UPDATE ... SET premium, 999999 WHERE email = ?  (batch of emails)."""
    m = in_list(usage, "email", emails, out="_hit")
    return m.withColumn("is_premium", F.col("_hit") | F.col("is_premium")).withColumn(
        "max_usage", F.when(F.col("_hit"), F.lit(S.ADMIN_MAX_USAGE)).otherwise(F.col("max_usage"))).drop("_hit")


def _roles(users: DataFrame, admins: DataFrame, testers: DataFrame, col: str = "_new_email") -> DataFrame:
    return in_list(in_list(users, col, admins, out="_admin"), col, testers, out="_test")


def signup_upsert(usage: DataFrame, signups: DataFrame, admins: DataFrame, testers: DataFrame,
                  as_of: Column) -> DataFrame:
    """The signup trigger over a batch of new users (id, email).

    Insert (0, admin ? 999999 : 10, admin); on conflict — admin: max,
    premium and email set; test: max 10, not premium, email; other: email only.
    """
    s = _roles(signups.select(F.col("id").alias("user_id"), F.col("email").alias("_new_email")),
               admins, testers)
    s = s.withColumnRenamed("_admin", "_a").withColumnRenamed("_test", "_t").withColumn("_hit", F.lit(True))
    j = usage.select(*USAGE_COLS).withColumn("_exists", F.lit(True)).join(s, "user_id", "full_outer")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    new_max = F.when(F.col("_a"), S.ADMIN_MAX_USAGE).otherwise(S.DEFAULT_MAX_USAGE)
    ins = hit & ~exists
    upd = hit & exists
    return j.select(
        "user_id",
        F.when(ins | upd, F.col("_new_email")).otherwise(F.col("email")).alias("email"),
        F.when(ins, F.lit(0).cast("long")).otherwise(F.col("usage_count")).alias("usage_count"),
        F.when(ins, new_max)
         .when(upd & F.col("_a"), F.lit(S.ADMIN_MAX_USAGE))
         .when(upd & F.col("_t"), F.lit(S.DEFAULT_MAX_USAGE))
         .otherwise(F.col("max_usage")).alias("max_usage"),
        F.when(ins, F.col("_a"))
         .when(upd & F.col("_a"), F.lit(True))
         .when(upd & F.col("_t"), F.lit(False))
         .otherwise(F.col("is_premium")).alias("is_premium"),
        F.when(ins, as_of).otherwise(F.col("created_at")).alias("created_at"),
        "last_used_at")


def backfill(usage: DataFrame, users: DataFrame, admins: DataFrame, testers: DataFrame,
             as_of: Column, ignore_conflicts: bool = False) -> DataFrame:
    """D11 (DO UPDATE) / D12 (DO NOTHING): usage rows for every user.

    Insert (0, admin ? 999999 : 10, admin).  On conflict (D11) — admin:
    999999 + premium; test: max 10, premium kept; other: unchanged; email and
    count are never changed.  D12 leaves conflicting rows untouched.
    """
    s = _roles(users.select(F.col("id").alias("user_id"), F.col("email").alias("_new_email")),
               admins, testers).withColumn("_hit", F.lit(True))
    j = usage.select(*USAGE_COLS).withColumn("_exists", F.lit(True)).join(s, "user_id", "full_outer")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    ins = hit & ~exists
    upd = hit & exists & F.lit(not ignore_conflicts)
    return j.select(
        "user_id",
        F.when(ins, F.col("_new_email")).otherwise(F.col("email")).alias("email"),
        F.when(ins, F.lit(0).cast("long")).otherwise(F.col("usage_count")).alias("usage_count"),
        F.when(ins, F.when(F.col("_admin"), S.ADMIN_MAX_USAGE).otherwise(S.DEFAULT_MAX_USAGE))
         .when(upd & F.col("_admin"), F.lit(S.ADMIN_MAX_USAGE))
         .when(upd & F.col("_test"), F.lit(S.DEFAULT_MAX_USAGE))
         .otherwise(F.col("max_usage")).alias("max_usage"),
        F.when(ins, F.col("_admin"))
         .when(upd & F.col("_admin"), F.lit(True))
         .otherwise(F.col("is_premium")).alias("is_premium"),
        F.when(ins, as_of).otherwise(F.col("created_at")).alias("created_at"),
        "last_used_at")
