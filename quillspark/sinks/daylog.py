"""A result log partitioned by day, with retention (D13) and a daily rollup (A4).

Layout: ``log/day=<date>/`` holds the rows, ``rollup/day=<date>/`` one row of counts
per day. Retention drops the folders of whole days and rewrites only the day that the
limit cuts; the rollup is counted again for days that rows came to or left. Both
can be run again after a crash with the same result: folders that are gone
stay gone, a cut day that was rewritten is cut at the same time. Rows without a time
are in a partition of their own, which retention never touches.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sinks.snapshots import materialize

ROLLUP = T.StructType([T.StructField("total_analyses", T.LongType()), T.StructField("unique_keywords", T.LongType()),
                       T.StructField("day", T.DateType())])


class DayLog:
    """Rows of ``schema`` by the day of ``ts``."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, ts: str = "created_at"):
        self.spark, self.base, self.schema, self.ts = spark, base.rstrip("/"), schema, ts

    def _write(self, rows: DataFrame, mode: str, folder: str = "log") -> None:
        (rows.repartition("day").write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(f"{self.base}/{folder}"))

    def _days(self, folder: str = "log") -> list[date]:
        """Days that have a folder; one entry per day of the calendar."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and n[4:5].isdigit())

    def _drop(self, days: list[date], folder: str = "log") -> None:
        for d in days:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{folder}/day={d.isoformat()}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def rows(self) -> DataFrame:
        """All rows with their ``day``; filters on ``day`` prune folders."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("day", T.DateType())])).parquet(f"{self.base}/log")

    def rollup(self) -> DataFrame:
        return self.spark.read.schema(ROLLUP).parquet(f"{self.base}/rollup")

    def append(self, rows: DataFrame) -> list[date]:
        """Adds rows and counts their days again; the days."""
        stored = materialize(rows.select(*self.schema.names, F.to_date(self.ts).alias("day")), "daylog_append")
        self._write(stored, "append")
        days = sorted(r.day for r in stored.select("day").where("day is not null").distinct().collect())     # days of the calendar
        self.refresh(days)
        return days

    def refresh(self, days: list[date]) -> None:
        """A4 per day, for ``days`` only; reads no other folder."""
        if days:
            counts = (self.rows().where(F.col("day").isin(days)).groupBy("day")
                      .agg(F.count(F.lit(1)).alias("total_analyses"), F.count_distinct("keyword").alias("unique_keywords")))
            self._write(counts.select(*ROLLUP.names), "overwrite", "rollup")

    def retain(self, as_of: datetime, days: int = 30) -> tuple[list[date], date]:
        """Rows older than ``as_of - days`` go. The days that were dropped whole
        and the day that was cut."""
        limit = as_of - timedelta(days=days)
        cut = limit.date()
        old = [d for d in self._days() if d < cut]
        self._drop(old)
        self._drop([d for d in self._days("rollup") if d < cut], "rollup")
        if cut in self._days():
            kept = materialize(self.rows().where((F.col("day") == F.lit(cut)) & (F.col(self.ts) >= F.lit(limit).cast(self.schema[self.ts].dataType))),
                               "daylog_cut")
            if kept.isEmpty():
                self._drop([cut])
                self._drop([cut], "rollup")
            else:
                self._write(kept, "overwrite")
                self.refresh([cut])
        return old, cut

    def daily_counts(self, as_of: datetime, days: int = 7) -> DataFrame:
        """A4 + F7: counts of the last ``days`` days. Whole days come from the rollup;
        only the day that the limit cuts is read from the log."""
        limit = as_of - timedelta(days=days)
        cut = F.lit(limit.date())
        part = (self.rows().where((F.col("day") == cut) & (F.col(self.ts) > F.lit(limit).cast(self.schema[self.ts].dataType))).groupBy("day")
                .agg(F.count(F.lit(1)).alias("total_analyses"), F.count_distinct("keyword").alias("unique_keywords")))
        whole = self.rollup().where(F.col("day") > cut)
        return whole.unionByName(part).select("total_analyses", "unique_keywords", F.col("day").alias("date"),
                                              F.col("total_analyses").alias("daily_count")).orderBy(F.desc("date"))
