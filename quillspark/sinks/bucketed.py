"""Keyed tables in hash buckets, with a commit log.

A table lives in one folder::

    data/c=<version>/bucket=<b>/...      rows that the commit wrote for a bucket
    deltas/c=<version>/bucket=<b>/...    changes that wait to be folded into it
    _commits/<version>.json              the manifest of the commit

A manifest names, for each bucket, the version that holds its rows and the
versions whose deltas come on top. Readers open exactly these folders, so their
cost does not grow with the number of commits. A writer puts its files under
the next version first and then adds the manifest by one rename; files of a
writer that died before are not in any manifest, so no reader sees them, and the
next writer replaces them. A manifest also keeps the last micro-batch of each
stream, so a replayed micro-batch finds itself done and changes nothing.

One writer at a time (the driver of a stream or job); any number of readers.
Manifests hold one small entry per bucket; rows never pass through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sinks.snapshots import materialize

FOLD_AFTER = 16         # deltas of a bucket from which ``compact`` folds them


@dataclass
class Manifest:
    version: int
    buckets: int
    rows: dict[int, int] = field(default_factory=dict)                  # bucket -> version of its rows
    deltas: dict[int, list[int]] = field(default_factory=dict)          # bucket -> versions of its deltas
    batches: dict[str, int] = field(default_factory=dict)               # stream -> last micro-batch

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "rows": self.rows, "deltas": self.deltas, "batches": self.batches})

    @staticmethod
    def parse(text: str) -> "Manifest":
        m = json.loads(text)
        return Manifest(m["version"], m["buckets"], {int(b): v for b, v in m["rows"].items()},
                        {int(b): v for b, v in m["deltas"].items()}, m["batches"])


class BucketTable:
    """A table keyed by ``key``; ``schema`` of its rows, ``delta_schema`` of its deltas."""

    def __init__(self, spark: SparkSession, base: str, key: str, schema: T.StructType, delta_schema: T.StructType | None = None,
                 buckets: int | None = None):
        """``buckets``: of a new table, else as many as shuffle partitions; a table keeps its number."""
        self.spark, self.base, self.key = spark, base.rstrip("/"), key
        self.schema, self.delta_schema = schema, delta_schema
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # -- commits ------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        fs, folder = self._fs(), self._path("_commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; a table without commits has none of its buckets."""
        if version is None:
            known = self.versions()
            if not known:
                return Manifest(-1, self.buckets)
            version = known[-1]
        stream = self._fs().open(self._path("_commits", f"{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest.parse(text)

    def _commit(self, m: Manifest) -> None:
        fs = self._fs()
        target, temporary = self._path("_commits", f"{m.version:012d}.json"), self._path("_commits", f"_{m.version:012d}.tmp")
        if fs.exists(target):
            raise RuntimeError(f"version {m.version} of {self.base} is committed already: a second writer is at work")
        out = fs.create(temporary, True)
        try:
            out.write(bytearray(m.text().encode()))
        finally:
            out.close()
        if not fs.rename(temporary, target):
            raise RuntimeError(f"version {m.version} of {self.base} could not be committed")

    # -- buckets ------------------------------------------------------------
    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.manifest().buckets)).cast("int")

    def touched(self, keys: DataFrame, col: str | None = None) -> list[int]:
        """Buckets that hold the keys: at most one entry per bucket reaches the driver."""
        found = keys.select(self.bucket_of(F.col(col or self.key)).alias("b")).distinct().collect()
        return sorted(r.b for r in found)

    def _write(self, rows: DataFrame, kind: str, version: int, schema: T.StructType) -> list[int]:
        """Rows by bucket under ``kind/c=<version>``; the buckets that got rows."""
        path = f"{self.base}/{kind}/c={version}"
        (rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
         .withColumn("bucket", self.bucket_of(F.col(self.key))).repartition("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(path))
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(kind, f"c={version}"))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))

    def _read(self, kind: str, places: list[tuple[int, int]], schema: T.StructType) -> DataFrame:
        """Current rows: one folder listing per version, pruned to its current buckets."""
        if not places:
            return self.spark.createDataFrame([], schema)
        of: dict[int, list[int]] = {}
        for b, v in places:
            of.setdefault(v, []).append(b)
        full = T.StructType([*schema.fields, T.StructField("c", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        found = (self.spark.read.schema(full).option("basePath", f"{self.base}/{kind}")
                 .parquet(*[f"{self.base}/{kind}/c={v}" for v in sorted(of)]))
        now = reduce(lambda x, y: x | y, [(F.col("c") == v) & F.col("bucket").isin(bs) for v, bs in of.items()])
        return found.where(now).select(*schema.names)

    # -- reading ------------------------------------------------------------
    def rows(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows as last written, without waiting deltas; of all buckets or of some."""
        m = self.manifest(version)
        wanted = set(m.rows if buckets is None else buckets)
        return self._read("data", [(b, v) for b, v in sorted(m.rows.items()) if b in wanted], self.schema)

    def deltas(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        wanted = set(m.deltas if buckets is None else buckets)
        places = [(b, v) for b, vs in sorted(m.deltas.items()) for v in vs if b in wanted]
        return self._read("deltas", places, self.delta_schema or self.schema)

    def open_folders(self) -> list[str]:
        """The folders that a reader of the newest version opens."""
        m = self.manifest()
        return ([f"data/c={v}/bucket={b}" for b, v in sorted(m.rows.items())]
                + [f"deltas/c={v}/bucket={b}" for b, vs in sorted(m.deltas.items()) for v in vs])

    # -- writing ------------------------------------------------------------
    def done(self, stream: str, batch: int) -> bool:
        """Whether a micro-batch of a stream is in the table already."""
        return self.manifest().batches.get(stream, -1) >= batch

    def _next(self, stream: str | None, batch: int | None) -> Manifest:
        m = self.manifest()
        batches = m.batches if stream is None else {**m.batches, stream: batch}
        return Manifest(m.version + 1, m.buckets, dict(m.rows), {b: list(v) for b, v in m.deltas.items()}, batches)

    def create(self, rows: DataFrame) -> None:
        """Version 0: all rows."""
        m = Manifest(0, self.buckets)
        m.rows = dict.fromkeys(self._write(rows, "data", 0, self.schema), 0)
        self._commit(m)

    def replace(self, rows: DataFrame, buckets: list[int], stream: str | None = None, batch: int | None = None) -> None:
        """``rows`` become all rows of ``buckets``; other buckets are not touched.
        Waiting deltas of these buckets must be in ``rows``; they are dropped."""
        m = self._next(stream, batch)
        got = self._write(rows, "data", m.version, self.schema)
        for b in buckets:
            m.rows.pop(b, None)
            m.deltas.pop(b, None)
        m.rows.update(dict.fromkeys(got, m.version))
        self._commit(m)

    def update(self, change: Callable[[DataFrame], DataFrame], keys: DataFrame | None = None, col: str | None = None,
               stream: str | None = None, batch: int | None = None) -> bool:
        """Rewrites the buckets of ``keys`` (None: all) by ``change``, which gets their
        current rows. A replayed micro-batch does nothing and gives False."""
        if stream is not None and self.done(stream, batch):
            return False
        buckets = list(range(self.manifest().buckets)) if keys is None else self.touched(keys, col)
        self.replace(change(self.rows(buckets)), buckets, stream, batch)
        return True

    def add_deltas(self, deltas: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        """Writes ``deltas`` alone, in the buckets they fall into."""
        m = self._next(stream, batch)
        for b in self._write(deltas, "deltas", m.version, self.delta_schema):
            m.deltas.setdefault(b, []).append(m.version)
        self._commit(m)

    def compact(self, fold: Callable[[DataFrame, DataFrame], DataFrame], after: int = FOLD_AFTER) -> list[int]:
        """Folds the deltas of buckets that have ``after`` or more into their rows."""
        due = sorted(b for b, vs in self.manifest().deltas.items() if len(vs) >= after)
        if due:
            self.replace(fold(self.rows(due), self.deltas(due)), due)
        return due

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the manifests before the last ``keep`` ones and the bucket folders
        that no kept one names; the number of folders that went."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        used = {("data", v, b) for m in kept for b, v in m.rows.items()} | {
            ("deltas", v, b) for m in kept for b, vs in m.deltas.items() for v in vs}
        fs, gone, newest = self._fs(), 0, known[-1]
        for kind in ("data", "deltas"):
            if not fs.exists(self._path(kind)):
                continue
            for commit in fs.listStatus(self._path(kind)):
                version = int(commit.getPath().getName().split("=")[1])
                if version > newest:                     # a writer may be at work there
                    continue
                folders = [s.getPath() for s in fs.listStatus(commit.getPath()) if s.isDirectory()]
                dead = [p for p in folders if (kind, version, int(p.getName().split("=")[1])) not in used]
                for p in [commit.getPath()] if len(dead) == len(folders) else dead:
                    fs.delete(p, True)
                gone += len(dead)
        for v in known[:-keep]:
            fs.delete(self._path("_commits", f"{v:012d}.json"), False)
        return gone


def stored(df: DataFrame, name: str) -> DataFrame:
    """A micro-batch that is read more than once, written once."""
    return materialize(df, name)
