"""Checked writes (D17, D3): NOT NULL, FOREIGN KEY and UNIQUE on a batch of rows.

Spark enforces none of them on a parquet write. ``check_rows`` gives every row of a
batch its verdict in one plan; ``write_checked`` stores it once, writes the good rows to the
table and the others with their codes to a reject table, and counts both
through ``observe`` while the verdicts are stored, without another pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.hotkeys import hot_join
from quillspark.sinks.snapshots import materialize

# The database's error codes.
NOT_NULL, FOREIGN_KEY, UNIQUE = "23502", "23503", "23505"


def check_rows(batch: DataFrame, table: T.StructType, order: list[str], unique: list[str] | None = None, existing: DataFrame | None = None,
               references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """``batch`` with ``error_code`` and ``error_column``, NULL where the row may be stored.

    Checked in turn: columns of ``table`` that are not nullable (those the batch
    names); ``references`` (column -> parent rows and key), where NULL refers to nothing;
    ``unique`` columns against ``existing`` rows and inside the batch, where the
    first sound row by ``order`` (which must end in a unique column) takes the key
    and NULLs differ from each other. A row that fails takes no key."""
    required = [f.name for f in table.fields if not f.nullable and f.name in batch.columns]
    column = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]) if required else F.lit(None).cast("string")
    rows = batch.withColumn("error_column", column).withColumn("error_code", F.when(F.col("error_column").isNotNull(), NOT_NULL))
    for c, (parents, key) in (references or {}).items():
        known = parents.select(F.col(key).alias(c)).where(F.col(c).isNotNull()).distinct().withColumn("_known", F.lit(True))
        rows = hot_join(rows, known, [c], "left")
        orphan = F.col("error_code").isNull() & F.col(c).isNotNull() & F.col("_known").isNull()
        rows = (rows.withColumn("error_column", F.when(orphan, F.lit(c)).otherwise(F.col("error_column")))
                .withColumn("error_code", F.when(orphan, FOREIGN_KEY).otherwise(F.col("error_code"))).drop("_known"))
    if unique:
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in unique])
        place = F.struct(*order)
        # One row per key and task is shuffled, whatever a key's share of the batch is.
        first = rows.where(F.col("error_code").isNull() & whole).groupBy(*unique).agg(F.min(place).alias("_first"))
        if existing is not None:
            taken = existing.select(*unique).distinct().withColumn("_taken", F.lit(True))
            first = first.join(taken, unique, "left")
        else:
            first = first.withColumn("_taken", F.lit(None).cast("boolean"))
        winners = first.where("_taken is null").select(F.col("_first").alias("_place")).withColumn("_wins", F.lit(True))
        rows = rows.withColumn("_place", place).join(winners, "_place", "left")
        loses = F.col("error_code").isNull() & whole & F.col("_wins").isNull()
        rows = (rows.withColumn("error_column", F.when(loses, F.lit(",".join(unique))).otherwise(F.col("error_column")))
                .withColumn("error_code", F.when(loses, UNIQUE).otherwise(F.col("error_code"))).drop("_place", "_wins"))
    return rows.select(*batch.columns, "error_code", "error_column")


def write_checked(checked: DataFrame, table_path: str, reject_path: str) -> dict[str, int]:
    """Appends the good rows to the table and the others to the reject table; counts by outcome."""
    seen = Observation("checked_write")
    codes = {"stored": F.col("error_code").isNull(), "not_null": F.col("error_code") == NOT_NULL,
             "foreign_key": F.col("error_code") == FOREIGN_KEY, "unique": F.col("error_code") == UNIQUE}
    stored = materialize(checked.observe(seen, *[F.count_if(c).alias(name) for name, c in codes.items()]), "checked_write")
    stored.where("error_code is null").drop("error_code", "error_column").write.mode("append").parquet(table_path)
    stored.where("error_code is not null").write.mode("append").parquet(reject_path)
    return dict(seen.get)
