"""Near-duplicate embeddings: pivot permutations in inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import by_group, partitions
from quillspark.llm.graph import components
from quillspark.session import ship_package
from quillspark.sinks.snapshots import materialize

MAX_PIVOTS = 4096       # bound of the sample that the index is fitted on
MAX_PIVOT_CELLS = 4_000_000
SEPARATION = 0.9        # pivots with a larger cosine than this to an earlier one are left out
DEPTH = 8               # nearest pivots that describe a vector
LISTS = 6               # of these, so many inverted lists hold the vector
SHARED = 2              # pivots that a candidate pair has in common
BLOCK = 512


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(ends)
    out = np.zeros((len(size), dim))
    at = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)
    out[np.repeat(np.arange(len(size)), size), at] = flat[ends[0]: ends[-1]]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def separated(u: np.ndarray, limit: float = SEPARATION) -> np.ndarray:
    """Unit vectors of which no two are closer than ``limit``, earlier ones first.
    A dense group then has about one pivot of its own, and its members are told
    apart from others by the same far pivots."""
    sim, free, chosen = u @ u.T, np.ones(len(u), bool), []
    for i in range(len(u)):
        if free[i]:
            chosen.append(i)
            free &= sim[i] < limit
    return u[chosen]


def nearest_pivots(u: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` nearest pivots of each unit vector, nearest first."""
    depth = min(depth, len(pivots))
    sim = u @ pivots.T
    part = np.argpartition(-sim, depth - 1, axis=1)[:, :depth]
    order = np.argsort(-np.take_along_axis(sim, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1).astype(np.int32)


def link_block(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside one block of an inverted list, or between two.

    A pair counts in the least list that holds both, if it shares enough pivots
    and the cosine confirms it. Gives per vector the weight of its links
    (a, null, n) and links that span each local component (a, b, 0).
    """
    pivot, n = int(rows["pivot"].iloc[0]), len(rows)
    cid, weight, side = rows["cid"].to_numpy(), rows["weight"].to_numpy(), rows["side"].to_numpy()
    near = np.stack(rows["pivots"].to_numpy())
    names, at = np.unique(near, return_inverse=True)
    at = at.reshape(near.shape)
    has = np.zeros((n, len(names)), np.float32)
    np.put_along_axis(has, at, 1, axis=1)
    shared = has @ has.T
    lists = np.zeros_like(has)
    np.put_along_axis(lists, at[:, :LISTS], 1, axis=1)
    lists[:, names >= pivot] = 0
    ok = (shared >= min(SHARED, near.shape[1])) & (lists @ lists.T == 0)
    ok &= (side[:, None] != side[None, :]) if side[0] != 1 else ~np.eye(n, dtype=bool)
    if not ok.any():
        return pd.DataFrame({"a": [], "b": [], "n": []})
    u = np.stack([np.frombuffer(v, np.float64) for v in rows["unit"]])
    ok &= u @ u.T >= threshold
    links = ok @ weight
    root = np.arange(n)
    while True:
        least = np.minimum(root, np.where(ok, root[None, :], n).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    linked, other = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
    return pd.DataFrame({"a": np.concatenate([cid[linked], cid[other]]),
                         "b": pd.array([pd.NA] * len(linked) + cid[root[other]].tolist(), dtype="Int64"),
                         "n": np.concatenate([links[linked], np.zeros(len(other), links.dtype)])})


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id",
                         vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    The index is fitted on pivots: vectors of least hash, 8 times the square
    root of the number of distinct vectors, ``MAX_PIVOTS`` and
    ``MAX_PIVOT_CELLS`` components at most, less those too close to another.
    Every vector is then indexed. It is described by its ``DEPTH`` nearest pivots
    in order; the first ``LISTS`` name the inverted lists that hold it.
    Pairs of one list (same label and dimension) that share ``SHARED`` pivots
    are confirmed by their cosine in double precision. Long lists are compared
    in blocks, equal vectors are one weighted entry, and a block gives counts and
    spanning links only, so a group of n near copies costs n rows, not n * n.

    Vectors that are null, zero, or hold null or non-finite components, and
    vectors without a label, link with nothing and are kept. Of repeated rows
    with the smallest vec_id the first is kept; an empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"),
                         F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    inf = float("inf")
    sound = F.coalesce(F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
                       & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = materialize(raw.withColumn("sound", sound).withColumn("k1", F.xxhash64("v"))
                       .withColumn("k2", F.xxhash64(F.lit(1), "v")), "embed_rows")
    key = ["label", "k1", "k2"]
    place = F.min(F.struct(F.col("vec_id").isNull().alias("n"), "vec_id", "row"))
    classes = materialize(rows.where("sound").groupBy(*key).agg(place.alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
                          .withColumn("cid", F.monotonically_increasing_id()), "embed_classes")
    count, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    wanted = max(1, min(MAX_PIVOTS, MAX_PIVOT_CELLS // dim, int(8 * count ** 0.5)))
    picked = classes.orderBy(F.xxhash64(F.lit(11), "k1"), "k2", "cid").limit(wanted).select("v").toPandas()["v"]
    pivots = np.zeros((len(picked), dim))
    for i, v in enumerate(picked):
        pivots[i, : len(v)] = v
    shared = spark.sparkContext.broadcast(separated(unit(pivots)) if len(pivots) else pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                u = unit(_matrix(part.column("v"), dim))
                near = nearest_pivots(u, shared.value, DEPTH)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("label"), part.column("weight"), part.column("dim"),
                     pa.array([x.tobytes() for x in u], pa.binary()), pa.array(near.tolist(), pa.list_(pa.int32()))],
                    names=["cid", "label", "weight", "dim", "unit", "pivots"])

    kind = classes.schema["label"].dataType.simpleString()
    index = (classes.select("cid", "label", "weight", F.size("v").alias("dim"), "v")
             .mapInArrow(describe, f"cid long, label {kind}, weight long, dim int, unit binary, pivots array<int>"))
    index = materialize(index, "embed_index")
    posted = index.select("cid", "label", "weight", "dim", F.explode(F.slice("pivots", 1, LISTS)).alias("pivot"))
    cuts = (posted.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cut"), F.count("*").alias("held"))
            .where("held > 1"))
    i = F.pmod(F.xxhash64("cid"), "cut").cast("int")
    blocks = (posted.join(cuts, ["label", "dim", "pivot"]).withColumn("i", i)
              .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
              .select("cid", "weight", "pivot", F.when(F.col("i") == F.col("j"), 1).when(F.col("i") < F.col("j"), 0).otherwise(2).alias("side"),
                      F.concat_ws("_", "label", "dim", "pivot", F.least("i", "j"), F.greatest("i", "j")).alias("g"))
              .join(index.select("cid", "unit", "pivots"), "cid"))
    found = materialize(blocks.repartition(partitions(spark), "g").sortWithinPartitions("g").mapInPandas(
        lambda frames: by_group(frames, lambda rows: link_block(rows, threshold)), "a long, b long, n long"), "embed_found")
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "cid")
    whole = materialize(classes.select("cid", "rep", "weight", *key).join(links, "cid", "left").join(roots, "cid", "left")
                        .withColumn("root", F.coalesce("root", "cid")), "embed_whole")
    best = whole.groupBy("root").agg(F.min("rep").alias("best"))
    per_class = whole.join(best, "root").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.col("best.vec_id").alias("component_id"), F.col("best.row").alias("best_row"))
    narrow = rows.drop("v")
    linked = narrow.where("sound").join(per_class, key).select(
        "vec_id", "n_links", "component_id", (F.col("row") == F.col("best_row")).alias("kept"))
    return linked.unionByName(narrow.where("not sound").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
