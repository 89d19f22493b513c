"""Near-duplicate documents: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import by_group, mix64, partitions, text_or_empty
from quillspark.llm.graph import components
from quillspark.session import ship_package
from quillspark.sinks.snapshots import materialize

WORDS = 5
COORDS = 384            # sketch length; one byte of each coordinate is kept
BANDS, ROWS = 48, 6     # a pair at 0.75 misses every band with odds under 1e-4
EST_MIN = 0.65          # 4.5 standard deviations below 0.75 for 384 coordinates
BLOCK = 256
BATCH_WORDS = 100_000   # words that a task holds as Python objects at a time


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (hashes, bounds); text i has
    ``hashes[bounds[i]:bounds[i + 1]]``, ascending. ASCII letters are lowered and
    words split at ASCII white space, which ``bytes`` does by itself."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(n.sum()))
    starts = np.concatenate([[0], np.cumsum(n)])
    rolled = np.zeros(len(flat), np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for k in range(WORDS):
        shifted = flat[k:]
        rolled[: len(shifted)] = rolled[: len(shifted)] * odd + shifted
    rolled = mix64(rolled)
    pieces = []
    for i, count in enumerate(n):
        a = starts[i]
        if count >= WORDS:
            one = np.sort(rolled[a: a + count - WORDS + 1])
            pieces.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        elif count:
            h = np.array([count], np.uint64)        # one shingle of fewer words; the count sets it apart
            for w in flat[a: a + count]:
                h = mix64(h * odd + w)
            pieces.append(h)
        else:
            pieces.append(np.empty(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    return (np.concatenate(pieces) if pieces else np.empty(0, np.uint64)), bounds


def sketches(hashes: np.ndarray, bounds: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Fast similarity sketching. In each of the first ``coords`` rounds every
    element falls into one hashed bin with a hashed value, and a bin keeps the
    smallest (round, value); in the next ``coords`` rounds all elements go to the
    round's own bin, so every coordinate of a set that isn't empty fills. A set
    leaves as soon as its bins are full. Returns one byte a coordinate."""
    docs = len(bounds) - 1
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    empty = np.uint64(2**64 - 1)
    bins = np.full(docs * coords, empty, np.uint64)
    h, d = hashes, owner
    for r in range(2 * coords):
        if not len(h):
            break
        x = mix64(h ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        bin_ = ((x >> np.uint64(32)) * np.uint64(coords) >> np.uint64(32)).astype(np.int64) if r < coords else r - coords
        value = np.uint64(r) << np.uint64(53) | mix64(x) >> np.uint64(11)
        np.minimum.at(bins, d * coords + bin_, value)
        if r < 4 or r % 4 == 0 or r >= coords:
            open_ = (bins.reshape(docs, coords) == empty).any(axis=1)
            stay = open_[d]
            h, d = h[stay], d[stay]
    return (mix64(bins) >> np.uint64(56)).astype(np.uint8).reshape(docs, coords)


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about ``BATCH_WORDS`` words (six bytes a word)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        before = int(size[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + 6 * BATCH_WORDS)))
        yield start, min(end, start + 1000, len(column))
        start = min(end, start + 1000, len(column))


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in _parts(batch.column("text")):
            hashes, bounds = shingle_sets(batch.column("text").slice(a, b - a).to_pylist())
            n = np.diff(bounds)
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes ^ np.uint64(salt)), dtype=np.uint64)])
                sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
            sk = sketches(hashes, bounds)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), part.column("text_hash"), pa.array(n, pa.int64()),
                 pa.array(sums[0]), pa.array(sums[1]), pa.array([x.tobytes() for x in sk], pa.binary())],
                names=["doc_id", "row", "text_hash", "n_shingles", "s1", "s2", "sketch"])
        pa.default_memory_pool().release_unused()


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = _band_keys(_sketch_matrix(batch.column("sketch").to_pylist()))
        cid = np.repeat(batch.column("cid").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cid)], names=["bk", "cid"])


def _sketch_matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, COORDS)


def _band_keys(sk: np.ndarray) -> np.ndarray:
    """A band's key: its number in the upper, its six coordinate bytes in the lower bits."""
    keys = np.zeros((len(sk), BANDS), np.int64)
    for k in range(ROWS):
        keys = keys << 8 | sk[:, k: BANDS * ROWS: ROWS]
    return keys | np.arange(BANDS, dtype=np.int64) << 48


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """The contract's rule on two full sets."""
    if 100 * min(len(x), len(y)) < 75 * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= 75 * (len(x) + len(y) - inter)


def _verify(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one group whose full shingle sets reach the similarity."""
    hashes, bounds = shingle_sets(list(texts["text"]))
    sets = {c: hashes[bounds[i]: bounds[i + 1]] for i, c in enumerate(texts["cid"])}
    good = []
    for a, b in zip(pairs["a"], pairs["b"]):
        if _similar(sets[a], sets[b]):
            good.append((a, b))
    return pd.DataFrame(good, columns=["a", "b"], dtype="int64")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs(g, a, b)`` and ``texts(cid, text)`` -> pairs that are linked.
    A text is sent to a group once, however many of the group's pairs hold it."""
    wanted = pairs.select("g", F.explode(F.array("a", "b")).alias("cid")).distinct()
    sent = wanted.join(texts, "cid").select(F.col("g").alias("h"), "cid", "text")
    return pairs.groupBy("g").cogroup(sent.groupBy("h")).applyInPandas(
        lambda p, t: _verify(p, t), "a long, b long")


def _grouped(pairs: DataFrame) -> DataFrame:
    """Star pairs (a: centre) in groups of about ``BLOCK`` pairs; the pairs of a
    centre with many are cut by the other end."""
    pairs = materialize(pairs, "near_pairs")
    groups = max(partitions(pairs.sparkSession), pairs.count() // BLOCK)
    cut = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("cut"))
    return pairs.join(cut, "a").select(
        F.concat_ws("_", F.pmod(F.xxhash64("a"), F.lit(groups)), F.when(F.col("cut") > 1, F.col("a")),
                    F.pmod(F.xxhash64("b"), F.col("cut"))).alias("g"), "a", "b")


def _close_pairs(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (as row numbers) of a block that are in different components, agree
    well enough by sketch, and share no earlier band. ``side``: 1 inside one
    block part, 0 and 2 for the two parts of a block between parts."""
    band = int(rows["bk"].iloc[0]) >> 48
    sk, cid, root, side = (_sketch_matrix(rows["sketch"]), rows["cid"].to_numpy(), rows["root"].to_numpy(),
                           rows["side"].to_numpy())
    keys = _band_keys(sk)
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
    for start in range(0, len(left), 32):
        at = left[start: start + 32]
        open_ = root[at][:, None] != root[right][None, :]
        if side[0] == 1:
            open_ &= cid[at][:, None] < cid[right][None, :]
        i, j = np.nonzero(open_)
        for k in range(0, len(i), 8192):
            x, y = at[i[k: k + 8192]], right[j[k: k + 8192]]
            ok = (sk[x] == sk[y]).mean(axis=1) >= EST_MIN
            x, y = x[ok], y[ok]
            first = (keys[x] == keys[y]).argmax(axis=1) == band
            yield x[first], y[first]


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a block, confirmed on full sets. Only texts in some close pair are
    read. Pairs that earlier links of the block join already are skipped: they
    change no component."""
    pairs = [(x, y) for xs, ys in _close_pairs(rows) for x, y in zip(xs.tolist(), ys.tolist())]
    use = sorted({i for pair in pairs for i in pair})
    hashes, bounds = shingle_sets(rows["text"].iloc[use].tolist())
    sets = {i: hashes[bounds[k]: bounds[k + 1]] for k, i in enumerate(use)}
    cid, root, links = rows["cid"].to_numpy(), rows["root"].to_numpy(), []
    top: dict[int, int] = {}

    def find(c: int) -> int:
        while top.get(c, c) != c:
            c = top[c]
        return c
    for x, y in pairs:
        a, b = find(int(root[x])), find(int(root[y]))
        if a != b and _similar(sets[x], sets[y]):
            top[a] = b
            links.append((cid[x], cid[y]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row, text_hash.

    1. Every text gets its set size, a 128-bit hash of its whole set and its
       sketch. Equal sets are one class from here on, so groups of copies cost
       one row.
    2. Classes meet in bands. Of each bucket every class is checked against the
       one of least id, on full sets.
    3. Buckets that still hold several components are compared in blocks by
       sketch; pairs of different components with an estimate of ``EST_MIN`` or
       more are checked on full sets as well. The texts come to the blocks, and
       only links leave them, never the pairs. Nothing is capped.
    4. Components over all links; component_id is the smallest doc_id.

    Null and blank texts have no shingles and link with nothing. Rows without a
    doc_id take part; component_id is null only where a whole component has
    none. Of repeated rows with the smallest doc_id the first is kept. An empty
    table gives an empty result.
    """
    ship_package(docs.sparkSession)
    text = text_or_empty(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = materialize(
        source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            _sketch_rows, "doc_id long, row long, text_hash long, n_shingles long, s1 long, s2 long, sketch binary"),
        "near_sketch")
    key = ["n_shingles", "s1", "s2"]
    place = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "text_hash"))
    classes = materialize(
        rows.where("n_shingles > 0").groupBy(*key).agg(place.alias("rep"), F.first("sketch").alias("sketch"))
        .withColumn("cid", F.monotonically_increasing_id()), "near_classes")
    bands = classes.select("sketch", "cid").mapInArrow(_band_rows, "bk long, cid long")
    full = bands.groupBy("bk").agg(F.count("*").alias("members"), F.min("cid").alias("pivot")).where("members > 1")
    members = materialize(bands.join(full, "bk"), "near_members")
    wanted = (members.select("cid").distinct().join(classes.select("cid", "rep", "sketch"), "cid")
              .select("cid", "sketch", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_th")))
    texts = materialize(
        source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")))
        .select("cid", "sketch", "text").dropDuplicates(["cid"]), "near_texts")

    stars = members.where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    first = components(verify(_grouped(stars), texts.drop("sketch")))
    rooted = members.join(first.withColumnRenamed("id", "cid"), "cid", "left").select(
        "bk", "cid", "members", F.coalesce("root", "cid").alias("root"))
    # A bucket of two was settled by its star.
    mixed = (rooted.where("members > 2").groupBy("bk")
             .agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bk"))
    cut = F.ceil(F.col("members") / BLOCK).cast("int")
    i = F.pmod(F.xxhash64("cid"), cut).cast("int")
    blocks = (rooted.join(mixed, "bk").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), cut - 1)))
              .select("bk", "cid", "root", F.when(F.col("i") == F.col("j"), 1).when(F.col("i") < F.col("j"), 0)
                      .otherwise(2).alias("side"),
                      F.concat_ws("_", "bk", F.least("i", "j"), F.greatest("i", "j")).alias("g"))
              .join(texts, "cid"))
    second = materialize(
        blocks.repartition(partitions(docs.sparkSession), "g").sortWithinPartitions("g")
        .mapInPandas(lambda frames: by_group(frames, _block_links), "a long, b long"), "near_second")

    def root_of(end: str, name: str) -> DataFrame:
        return first.select(F.col("id").alias(end), F.col("root").alias(name))
    joined = (second.join(root_of("a", "ra"), "a", "left").join(root_of("b", "rb"), "b", "left")
              .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    again = components(joined).select(F.col("id").alias("root"), F.col("root").alias("top"))
    tops = (classes.select("cid", "rep", *key).join(first.withColumnRenamed("id", "cid"), "cid", "left")
            .withColumn("root", F.coalesce("root", "cid")).join(again, "root", "left")
            .withColumn("top", F.coalesce("top", "root")))
    tops = materialize(tops.select("top", "rep", *key), "near_tops")
    reps = tops.groupBy("top").agg(F.min("rep").alias("best"))
    resolved = tops.join(reps, "top").select(*key, F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("best_row"))
    linked = (rows.drop("sketch").where("n_shingles > 0").join(resolved, key)
              .select("doc_id", "n_shingles", "component_id", (F.col("row") == F.col("best_row")).alias("kept"), "row", "text_hash"))
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"),
                                                F.lit(True).alias("kept"), "row", "text_hash")
    return linked.unionByName(alone)
