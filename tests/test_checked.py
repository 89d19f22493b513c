"""Checked writes on a small batch."""

from pyspark.sql import types as T

from quillspark.operators.checked import check_rows, write_checked
from quillspark.session import shared_path

TABLE = T.StructType([T.StructField("u", T.LongType(), False), T.StructField("k", T.StringType(), True)])


def test_codes_counts_and_tables(spark):
    rows = [(1, 10, "a"), (2, 10, "a"), (3, None, "b"), (4, 99, "b"), (5, 20, "x"), (6, 10, None), (7, 10, None), (8, 20, "b")]
    batch = spark.createDataFrame(rows, "n int, u long, k string")
    users = spark.createDataFrame([(10,), (20,), (None,)], "id long")
    existing = spark.createDataFrame([(20, "x")], "u long, k string")
    checked = check_rows(batch, TABLE, ["n"], ["u", "k"], existing, {"u": (users, "id")})
    assert {r.n: r.error_code for r in checked.collect()} == {1: None, 2: "23505", 3: "23502", 4: "23503", 5: "23505", 6: None, 7: None, 8: None}
    table, rejects = shared_path(spark, "test", "good"), shared_path(spark, "test", "bad")
    assert write_checked(checked, table, rejects) == {"stored": 4, "not_null": 1, "foreign_key": 1, "unique": 2}
    assert sorted(r.n for r in spark.read.parquet(table).collect()) == [1, 6, 7, 8]
    assert sorted((r.n, r.error_column) for r in spark.read.parquet(rejects).collect()) == [(2, "u,k"), (3, "u"), (4, "u"), (5, "u,k")]
    empty = check_rows(batch.limit(0), TABLE, ["n"], ["u", "k"], existing, {"u": (users, "id")})
    assert empty.count() == 0
