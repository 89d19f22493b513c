"""Driving Structured Streaming queries from file sources to completion.

Every stream reads a folder of files and runs with
``trigger(availableNow=True)``; checkpoints and outputs live under the shared folder, so a restarted query
resumes from its last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from quillspark.session import shared_path
from quillspark.sinks.snapshots import materialize


def stage_files(df: DataFrame, name: str, *split_cols: str) -> str:
    """Write ``df`` as one parquet file per shuffle partition, split by ranges of
    ``split_cols``, and return the folder."""
    spark = df.sparkSession
    path = shared_path(spark, "stream-in", name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *split_cols).sortWithinPartitions(*split_cols).write.parquet(path)
    return path


def read_files(spark: SparkSession, path: str, schema, batches: int | None = None) -> DataFrame:
    """File stream; with ``batches``, the staged files are read in about so many
    micro-batches, each in as many tasks as it has files."""
    stream = spark.readStream.schema(schema)
    if batches:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        stream = stream.option("maxFilesPerTrigger", max(1, n // batches))
    return stream.parquet(path)


def stage_in_order(df: DataFrame, name: str, *order_cols: str) -> str:
    """As ``stage_files``, with file times in the order of the ranges: a file stream
    takes files by their time. The rows are written once before, so that finding
    the ranges does not read their source again."""
    spark = df.sparkSession
    path = stage_files(materialize(df, f"stream_{name}"), name, *order_cols)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    start = max((f.getModificationTime() for f in files), default=0) - 1000 * len(files)
    for i, f in enumerate(files):
        fs.setTimes(f.getPath(), start + 1000 * i, -1)
    return path


def run_to_completion(spark: SparkSession, writer: DataStreamWriter) -> None:
    """Start with availableNow and block until every file is processed.

    Batches without data are off: with a processing-time timeout Spark would
    run them without end, and timeouts fire in the next batch with data anyway.
    """
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        q = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    try:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    finally:
        if q.isActive:
            q.stop()
