"""Catalog scans (SRC7, SRC8) as DataFrames over ``SHOW TABLES`` / ``DESCRIBE``.

Tables are registered as temp views of their current snapshot; the schema
comments of ``schemas`` travel as column metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def register(spark: SparkSession, name: str, df: DataFrame, schema: T.StructType | None = None) -> None:
    """Register a snapshot as a view, carrying column comments from ``schema``."""
    if schema is not None:
        meta = {f.name: f.metadata for f in schema.fields}
        df = df.select(*[F.col(c).alias(c, metadata=meta.get(c, {})) for c in df.columns])
    df.createOrReplaceTempView(name)


def table_count(spark: SparkSession, names: list[str]) -> DataFrame:
    """SRC7: how many of ``names`` exist (one row, with a status label)."""
    t = spark.sql("SHOW TABLES").filter(F.col("tableName").isin(names))
    return t.agg(F.count(F.lit(1)).alias("tables_created")).select(
        F.lit("Setup completed successfully!").alias("status"), "tables_created")


def columns(spark: SparkSession, table: str) -> DataFrame:
    """SRC8: column name, type, nullability and comment in ordinal order."""
    d = spark.sql(f"DESCRIBE TABLE {table}").filter(~F.col("col_name").startswith("#"))
    fields = {f.name: f for f in spark.table(table).schema.fields}
    nullable = F.create_map(*[x for n, f in fields.items() for x in (F.lit(n), F.lit(f.nullable))])
    return (d.withColumn("ordinal_position", F.monotonically_increasing_id() + 1)
             .select(F.col("col_name").alias("column_name"), F.col("data_type"),
                     nullable[F.col("col_name")].alias("is_nullable"), "comment", "ordinal_position")
             .orderBy("ordinal_position"))
