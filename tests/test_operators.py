"""Operator invariants: skew-split scans equal plain windows, NULL rules of
NOT IN, upsert idempotence, stream = batch."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from quillspark.operators import usage as U
from quillspark.operators.scan import asof_last_id, keyed_row_number, placed
from quillspark.sources import fixtures as fx
from quillspark.sources.tables import Tables


def _hot_requests(t):
    # A third of all requests share one keyword and one user: the hot key.
    r = fx.requests(t)
    hot = F.col("request_id") % 3 == 0
    return r.withColumns({"keyword": F.when(hot, F.lit("hot")).otherwise(F.col("keyword")),
                          "user_id": F.when(hot, F.lit(7)).otherwise(F.col("user_id"))})


def _hot_results(t):
    r = fx.results(t)
    return r.withColumn("keyword", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("keyword")))


def test_asof_equals_brute_force_on_hot_key(spark):
    t = Tables(spark, SF_SMALL)
    req, res = _hot_requests(t).select("request_id", "keyword", "ts"), _hot_results(t)
    for text_ids in (False, True):
        if text_ids:        # ids of the engine's own schema are texts
            res = res.withColumn("id", F.md5(F.col("id").cast("string")))
        got = asof_last_id(req, res.select("keyword", "created_at", "id"), ["keyword"], "ts", "created_at",
                           "id", "hit")
        pairs = req.alias("q").join(res.alias("r"), (F.col("q.keyword") == F.col("r.keyword"))
                                    & (F.col("r.created_at") < F.col("q.ts")), "left")
        brute = pairs.groupBy("q.request_id").agg(
            F.max_by("r.id", F.struct("r.created_at", "r.id")).alias("hit"))
        a = {r.request_id: r.hit for r in got.select("request_id", "hit").collect()}
        b = {r.request_id: r.hit for r in brute.collect()}
        assert a == b


def test_keyed_row_number_equals_window(spark):
    t = Tables(spark, SF_SMALL)
    req = _hot_requests(t).select("request_id", "user_id", "ts")
    burst = req.withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-20 12:00:00")))
    outlier = req.unionByName(req.limit(1).select(F.lit(-1).cast("long").alias("request_id"), "user_id",
                                                  F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")).alias("ts")))
    nulls = req.withColumn("ts", F.when(F.col("request_id") % 2 == 0, F.col("ts")))
    for case in (req, burst, outlier, nulls, req.withColumn("request_id", F.md5(F.col("request_id").cast("string")))):
        got = keyed_row_number(case, ["user_id"], [F.col("ts"), F.col("request_id")], "rn")
        w = Window.partitionBy("user_id").orderBy("ts", "request_id")
        exp = case.withColumn("rn", F.row_number().over(w))
        assert sorted(got.select("request_id", "rn").collect()) == sorted(exp.select("request_id", "rn").collect())
        groups = placed(case, ["user_id"], [F.col("ts"), F.col("request_id")], "t").groupBy("_part").count()
        assert groups.agg(F.max("count")).first()[0] <= 0.5 * case.count()      # the hot user is cut


def _exchanges(df):
    """Shuffles of the plan without adaptive re-planning and broadcasts of measured sides."""
    spark = df.sparkSession
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return [line.split("Exchange ")[1] for line in plan.splitlines() if "- Exchange " in line]


def test_scans_move_rows_once(spark):
    """After the ranges are stored, only one row per range moves."""
    t = Tables(spark, SF_SMALL)
    req = _hot_requests(t).select("request_id", "keyword", "user_id", "ts")
    numbered = keyed_row_number(req, ["user_id"], [F.col("ts"), F.col("request_id")], "rn")
    looked_up = asof_last_id(req, _hot_results(t).select("keyword", "created_at", "id"), ["keyword"], "ts", "created_at", "id", "hit")
    for df in (numbered, looked_up):
        moved = _exchanges(df)
        assert len(moved) == 2 and moved[0].startswith("SinglePartition") and moved[1].startswith("hashpartitioning(_last#"), moved


def test_ranges_lie_in_own_buckets(spark):
    rows = spark.range(0, 5000, 1, 3).withColumn("k", F.col("id") % 7)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = placed(rows, ["k"], [F.col("id")], "t")
    per_task = got.groupBy(F.pmod(F.hash("_slot"), F.lit(n)).alias("b")).agg(F.count_distinct("_part").alias("ranges"),
                                                                             F.min("_part").alias("lo"))
    assert {(r.b, r.ranges, r.lo) for r in per_task.collect()} == {(p, 1, p) for p in range(n)}
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("quillspark_stage_")]


def test_scans_of_empty_one_row_and_two_keys(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, None, 6), (None, "a", 7), (None, None, 8), (1, None, 9), (None, None, 10)],
                                 "k long, j string, i long")
    for case in (rows.limit(0), rows.where("i = 8"), rows, rows.crossJoin(spark.range(300)).select("k", "j", F.col("id").alias("i"))
                 .withColumn("i", F.monotonically_increasing_id())):
        w = Window.partitionBy("k", "j").orderBy("i")
        got = keyed_row_number(case, ["k", "j"], [F.col("i")], "rn")
        assert got.columns == ["k", "j", "i", "rn"]
        want = case.withColumn("rn", F.row_number().over(w))
        assert {(r.i, r.rn) for r in got.collect()} == {(r.i, r.rn) for r in want.collect()}


def test_not_in_null_rules(spark):
    users = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    no_null = spark.createDataFrame([(1,)], "user_id long")
    with_null = spark.createDataFrame([(1,), (None,)], "user_id long")
    assert [r.id for r in U.not_in(users, "id", no_null, "user_id").collect()] == [2]
    assert U.not_in(users, "id", with_null, "user_id").count() == 0
    assert U.not_in(users, "id", no_null.limit(0), "user_id").count() == 3


def test_backfill_is_idempotent_and_keys_unique(spark):
    t = Tables(spark, SF_SMALL)
    start = fx.request_start()
    once = U.backfill(fx.usage(t), fx.users(t), fx.admin_emails(t), fx.test_emails(t), start)
    once = spark.createDataFrame(once.collect(), once.schema)
    twice = U.backfill(once, fx.users(t), fx.admin_emails(t), fx.test_emails(t), start)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert once.count() == once.select("user_id").distinct().count()
    ignore = U.backfill(fx.usage(t), fx.users(t), fx.admin_emails(t), fx.test_emails(t), start, True)
    untouched = fx.usage(t).select(*U.USAGE_COLS).exceptAll(ignore.select(*U.USAGE_COLS))
    assert untouched.count() == 0


def test_admission_matches_sequential_fold(spark):
    t = Tables(spark, SF_SMALL)
    req = _hot_requests(t).filter(F.col("user_id").isNotNull()).select("request_id", "user_id", "ts")
    usage = fx.usage(t)
    got = {r.request_id: (r.admitted, r.usage_before)
           for r in U.admit(req, usage).select("request_id", "admitted", "usage_before").collect()}
    u = {r.user_id: r for r in usage.collect()}
    count = {}
    for r in sorted(req.collect(), key=lambda r: (r.ts, r.request_id)):
        if r.user_id not in u:
            continue
        row = u[r.user_id]
        before = count.setdefault(r.user_id, row.usage_count)
        ok = row.is_premium or before < row.max_usage
        if ok:
            count[r.user_id] += 1
        assert got[r.request_id] == (ok, before)


def test_signup_batches_write_touched_buckets(spark):
    from quillspark.session import shared_path
    from quillspark.sinks.bucketed import BucketTable
    from quillspark.streaming.signup import signup_batch_writer
    t = Tables(spark, SF_SMALL)
    usage = fx.usage(t).select(*U.USAGE_COLS)
    table = BucketTable(spark, shared_path(spark, "test", "usage_bucketed"), "user_id", usage.schema, buckets=16)
    table.create(usage)
    old = sorted(table.rows().collect(), key=str)
    batch = fx.signups(t).limit(3)
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    touched = table.touched(batch, "id")
    apply = signup_batch_writer(table, fx.admin_emails(t), fx.test_emails(t), fx.request_start())
    apply(batch, 0)
    assert {b for b, v in table.manifest().rows.items() if v == 1} == set(touched)
    assert sorted(table.rows(version=0).collect(), key=str) == old
    want = U.signup_upsert(usage, batch, fx.admin_emails(t), fx.test_emails(t), fx.request_start())
    want = sorted(want.select(*U.USAGE_COLS).collect(), key=str)
    assert sorted(table.rows().collect(), key=str) == want
    apply(batch, 0)            # a replay finds itself in the manifest
    assert table.versions() == [0, 1] and sorted(table.rows().collect(), key=str) == want
