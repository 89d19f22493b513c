"""Driver tables: one parquet dataset per name under a scale-factor folder.

Reads are lazy and schema-on-read from parquet footers; Catalyst prunes
columns and pushes filters into each scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")


# Session setting: hash-partition every scanned table on its first column into so
# many tasks. For tables in single-row-group files, which one task reads; unset
# by default, and never guessed from sizes or file counts.
SCAN_PARTITIONS = "spark.quillspark.scan.partitions"


class Tables:
    """Name -> DataFrame accessor for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            df = self.spark.read.parquet(self.path(name))
            n = self.spark.conf.get(SCAN_PARTITIONS, "")
            self._cache[name] = df.repartition(int(n), df.columns[0]) if n else df
        return self._cache[name]
