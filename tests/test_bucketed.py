"""Bucket tables: many commits, a crash between write and commit, compaction, vacuum."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import shared_path
from quillspark.sinks.bucketed import BucketTable

ROWS = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
DELTAS = T.StructType([T.StructField("k", T.LongType()), T.StructField("added", T.LongType())])


def fold(rows, deltas):
    total = deltas.groupBy("k").agg(F.sum("added").alias("a"))
    return rows.join(total, "k", "left").select("k", (F.col("n") + F.coalesce("a", F.lit(0))).alias("n"))


@pytest.fixture()
def table(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    t = BucketTable(spark, shared_path(spark, "test", "bucketed"), "k", ROWS, DELTAS, buckets=4)
    t.create(spark.createDataFrame([(k, 0) for k in range(20)] + [(None, 0)], ROWS))
    yield t
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def opened(df):
    return {"/".join(r.f.split("/")[-4:-1]) for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_200_micro_batches_with_crashes(spark, table, monkeypatch):
    want, folders = Counter(), []
    for batch in range(200):
        changes = [(batch % 20, 1), ((batch * 7) % 20, 2)]
        deltas = spark.createDataFrame(changes, DELTAS)
        if batch in (3, 77, 150):                       # files are written, the manifest is not
            with monkeypatch.context() as m:
                m.setattr(BucketTable, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    table.add_deltas(deltas, "s", batch)
            assert table.manifest().batches.get("s", -1) == batch - 1
        for _ in range(2 if batch % 50 == 0 else 1):    # some micro-batches are replayed
            if not table.done("s", batch):
                table.add_deltas(deltas, "s", batch)
        for k, n in changes:
            want[k] += n
        table.compact(fold, after=24)
        folders.append(len(table.open_folders()))
    assert max(folders) <= 4 * 25                       # however many commits there are
    now = fold(table.rows(), table.deltas())
    assert {r.k: r.n for r in now.collect()} == {**{k: want[k] for k in range(20)}, None: 0}
    current = set(table.open_folders())
    assert opened(table.rows()) | opened(table.deltas()) <= current
    assert table.vacuum() > 0 and set(table.open_folders()) == current
    assert len(table.versions()) == 1
    assert {r.k: r.n for r in fold(table.rows(), table.deltas()).collect()} == {**{k: want[k] for k in range(20)}, None: 0}


def test_updates_rewrite_touched_buckets_only(spark, table):
    keys = spark.createDataFrame([(3, 0)], ROWS)
    before = table.manifest().rows
    assert table.update(lambda rows: rows.withColumn("n", F.when(F.col("k") == 3, 9).otherwise(F.col("n"))), keys, stream="s", batch=0)
    after = table.manifest().rows
    assert [b for b in after if after[b] != before[b]] == table.touched(keys)
    assert {r.k: r.n for r in table.rows().collect()}[3] == 9
    assert not table.update(lambda rows: rows.limit(0), keys, stream="s", batch=0)
    assert table.rows().count() == 21 and table.rows(version=0).where("n > 0").count() == 0
    table.update(lambda rows: rows.limit(0), keys)                     # a bucket may become empty
    assert table.rows().where("k = 3").count() == 0


def test_a_second_writer_is_refused(spark, table):
    taken = table.manifest()
    table.add_deltas(spark.createDataFrame([(1, 1)], DELTAS))
    taken.version += 1
    with pytest.raises(RuntimeError, match="second writer"):
        table._commit(taken)
