"""Session construction and the shared work folder.

Library code never invents a storage location: anything that must survive an
executor loss (checkpoints, snapshot tables, streaming state) goes under the
folder the cluster names in ``spark.checkpoint.dir``.  Only tests and the
bench set that folder, and only when the session leaves it unset.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "quillspark", extra: dict | None = None) -> SparkSession:
    """Session for local runs and tests.  Cluster jobs get theirs from the launcher."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    return sc.getConf().get("spark.checkpoint.dir") or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only when unset (tests)."""
    d = _configured_dir(spark)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: stage tables, snapshots and stream "
                               "checkpoints need a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="quillspark-ckpt-")   # local runs / tests only
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique path under the shared folder (one per call)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return os.path.join(base, "quillspark", *parts, uuid.uuid4().hex)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quillspark`` importable in Python workers (once per SparkContext).

    Python-side functions (the generate stage, streaming state functions) are
    pickled by reference, so executors must import this package.  It is zipped
    into the shared folder and added with ``addPyFile``, which distributes it
    to every executor, including ones started later.
    """
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = shared_path(spark, "pyfiles") + ".zip"
    local = re.sub("^file:/*", "/", target)
    if "://" in local:     # remote shared storage: build locally, Spark copies it from the driver
        local = os.path.join(tempfile.mkdtemp(prefix="quillspark-zip-"), "quillspark.zip")
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.join("quillspark", os.path.relpath(full, root)))
    sc.addPyFile(local)
    _SHIPPED.add(key)
