"""Writing tables: versioned snapshots of the DML operators, stage tables that
cut lineage, and appends.

Parquet has no in-place DML here, so each write operator yields the next
snapshot as a DataFrame and ``write_snapshot`` stores it under a new version
path; readers pick the newest complete version.  Everything lives under the
shared folder named by ``spark.checkpoint.dir`` (see ``session``), never on
a machine-local path, so a lost executor only costs a task retry.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from quillspark.session import shared_path

# Session setting of Spark: a query's shuffle files go when it has ended, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGES: ContextVar[list[str] | None] = ContextVar("stages", default=None)


@contextmanager
def written_stages() -> Iterator[list[str]]:
    """Paths of the stage tables written inside, for ``drop_stages``."""
    paths: list[str] = []
    token = _STAGES.set(paths)
    try:
        yield paths
    finally:
        _STAGES.reset(token)


def drop_stages(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stage tables that nothing reads any more: what was built on them is stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def _stage(spark: SparkSession, name: str) -> Iterator[str]:
    """Path of a new stage table; the shuffle files of its write go with it, as the table cuts the lineage."""
    path = shared_path(spark, "stage", name)
    if (written := _STAGES.get()) is not None:
        written.append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield path
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate consumed more than once and read it back.

    Cuts the lineage (later stages restart from the table, not from the
    sources) and gives AQE exact sizes for the next joins.
    """
    with _stage(df.sparkSession, name) as path:
        df.write.mode("overwrite").parquet(path)
    # Known schema: no inference pass, and an empty intermediate reads back fine.
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """``materialize`` with the rows in hash buckets of ``by``: later windows and
    aggregates by it (and more) and joins on it need no exchange. ``df`` comes with
    one bucket per task. Only a catalog table tells the reader of its buckets; the
    entry goes once the plan has them, the files stay.
    """
    spark = df.sparkSession
    if buckets > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
        return materialize(df, name)
    with _stage(spark, name) as path:
        table = "quillspark_stage_" + path.rsplit("/", 1)[1]
        df.write.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(table)
    back = spark.read.table(table)
    spark.sql(f"DROP TABLE {table}")
    return back.select(*df.columns)


def write_snapshot(df: DataFrame, base: str, version: int, partition_by: list[str] | None = None) -> str:
    """Store the next snapshot of a table at ``base/v=<version>`` (overwrite is
    idempotent, so a retried job writes the same version)."""
    path = f"{base.rstrip('/')}/v={version}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def latest_version(spark: SparkSession, base: str, below: int | None = None) -> int | None:
    """Newest committed version under ``base``, or the newest one before ``below``."""
    vs = [v for v in complete_versions(spark, base) if below is None or v < below]
    return max(vs) if vs else None


def complete_versions(spark: SparkSession, base: str) -> list[int]:
    """Committed versions under ``base`` (any Hadoop file system), ascending."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    vs = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            vs.append(int(name[2:]))
    return sorted(vs)


def append(df: DataFrame, path: str) -> None:
    """Append rows to a log table."""
    df.write.mode("append").parquet(path)
