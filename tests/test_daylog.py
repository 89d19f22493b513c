"""The result log by days: pruning, retention, rollup."""

from datetime import date, datetime

from pyspark.sql import functions as F

from quillspark.session import shared_path
from quillspark.sinks.daylog import DayLog


def test_retention_touches_old_days_only(spark):
    rows = [(d * 10 + h, f"k{h % 2}", datetime(2024, 1, d, h)) for d in range(1, 7) for h in (1, 13, 20)] + [(99, "x", None)]
    df = spark.createDataFrame(rows, "id long, keyword string, created_at timestamp_ntz")
    log = DayLog(spark, shared_path(spark, "test", "daylog"), df.schema)
    assert log.append(df.where("id % 2 = 0 or id = 99")) and log.append(df.where("id % 2 = 1 and id <> 99"))
    before = {r.f for r in log.rows().where("day > '2024-01-03'").select(F.input_file_name().alias("f")).distinct().collect()}
    for _ in range(2):                                    # run again after a crash: the same result
        old, cut = log.retain(datetime(2024, 1, 5, 13), 2)
        assert cut == date(2024, 1, 3)
    got = {r.id for r in log.rows().collect()}
    assert got == {r[0] for r in rows if r[2] is None or r[2] >= datetime(2024, 1, 3, 13)}
    assert {r.f for r in log.rows().where("day > '2024-01-03'").select(F.input_file_name().alias("f")).distinct().collect()} == before
    counts = {str(r.day): (r.total_analyses, r.unique_keywords) for r in log.rollup().collect()}
    assert counts == {"2024-01-03": (2, 2), "2024-01-04": (3, 2), "2024-01-05": (3, 2), "2024-01-06": (3, 2)}
    plan = log.rows().where(F.col("day") == F.lit(date(2024, 1, 4)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    got = [(str(r.date), r.total_analyses) for r in log.daily_counts(datetime(2024, 1, 7, 13), 3).collect()]
    assert got == [("2024-01-06", 3), ("2024-01-05", 3), ("2024-01-04", 1)]
