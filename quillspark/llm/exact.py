"""Exact dedup against a minimal perfect hash over known digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES, mix64, partitions, text_or_empty
from quillspark.session import ship_package
from quillspark.sinks.snapshots import materialize

INDEX_SCHEMA = ("bucket int, level_bits array<int>, bits binary, slots binary, winner_null array<boolean>, "
                "winner array<long>, winner_row array<long>, copies array<long>")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, text_hash, digest): SHA-256 of the text with white space runs
    as one space; null counts as empty. ``row`` tells repeated rows apart."""
    text = F.regexp_replace(text_or_empty(text_col), SPACES, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.xxhash64(text_or_empty(text_col)).alias("text_hash"), F.unhex(F.sha2(text, 256)).alias("digest"))


def winners(rows: DataFrame) -> DataFrame:
    """Distinct digests with the locator of the row that stays: the smallest
    doc_id (null last), then the first row. Copies are combined before the shuffle."""
    place = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
    return (rows.groupBy("digest").agg(place.alias("w"), F.count("*").alias("copies"))
            .select("digest", F.col("w.doc_id").alias("winner"), F.col("w.row").alias("winner_row"), "copies"))


def _words(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digest), dtype="<u8").reshape(-1, 4)


def _level_hash(words: np.ndarray, level: int) -> np.ndarray:
    x = words[:, level % 4] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mix64(x ^ words[:, (level + 1) % 4])


def build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket's minimal perfect hash: at each level keys that fall alone on
    a bit keep it, the others go on to the next level; a key's slot is the
    number of bits set before its own."""
    words = _words(pdf["digest"])
    left, levels, where, base = np.arange(len(words)), [], np.empty(len(words), np.int64), 0
    bits = []
    while len(left):
        size = max(2, int(len(left) * 1.25))
        pos = (_level_hash(words[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(pos, minlength=size)[pos] == 1
        level = np.zeros(size, np.uint8)
        level[pos[alone]] = 1
        where[left[alone]] = base + pos[alone]
        bits.append(level)
        levels.append(size)
        base += size
        left = left[~alone]
    flat = np.concatenate(bits)
    slot = np.cumsum(flat)[where] - 1
    order = np.argsort(slot)
    by_slot = pdf.iloc[order]
    return pd.DataFrame([{
        "bucket": int(pdf["bucket"].iloc[0]), "level_bits": levels, "bits": np.packbits(flat).tobytes(),
        "slots": words[order].tobytes(), "winner_null": by_slot["winner"].isna().tolist(),
        "winner": by_slot["winner"].fillna(0).astype("int64").tolist(),
        "winner_row": by_slot["winner_row"].tolist(), "copies": by_slot["copies"].tolist()}])


def lookup_bucket(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Rows of one bucket against its index; a slot counts only if all 32 bytes agree."""
    n = len(rows)
    member, slot = np.zeros(n, bool), np.zeros(n, np.int64)
    if n and len(index):
        ix = index.iloc[0]
        words = _words(rows["digest"])
        sizes = [int(x) for x in ix["level_bits"]]
        flat = np.unpackbits(np.frombuffer(ix["bits"], np.uint8))[: sum(sizes)]
        rank = np.cumsum(flat)
        left, base = np.arange(n), 0
        for level, size in enumerate(sizes):
            at = base + (_level_hash(words[left], level) % np.uint64(size)).astype(np.int64)
            hit = flat[at] == 1
            slot[left[hit]] = rank[at[hit]] - 1
            member[left[hit]] = True
            left, base = left[~hit], base + size
        known = np.frombuffer(ix["slots"], dtype="<u8").reshape(-1, 4)
        member &= (known[slot] == words).all(axis=1)
        null, win, wrow, cop = (np.asarray(ix[c])[slot] for c in ("winner_null", "winner", "winner_row", "copies"))
    else:
        null, win, wrow, cop = np.zeros(n, bool), slot, slot, slot
    out = rows[["doc_id", "row", "text_hash", "digest"]].assign(
        member=member, keep_id=pd.array(win, dtype="Int64"), keep_row=wrow, group_size=cop)
    out.loc[null.astype(bool) | ~member, "keep_id"] = pd.NA
    return out


def build_index(known: DataFrame, keys_per_bucket: int = 16384) -> tuple[DataFrame, int]:
    """``winners`` rows -> written index, one row per bucket of digests, and the
    bucket count. A bucket's keys bound its task's memory (about 100 bytes a key)."""
    spark = known.sparkSession
    ship_package(spark)
    known = materialize(known, "exact_known")
    n = max(partitions(spark), -(-known.count() // keys_per_bucket))
    keyed = known.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int"))
    return materialize(keyed.groupBy("bucket").applyInPandas(build_bucket, INDEX_SCHEMA), "exact_index"), n


def lookup(rows: DataFrame, index: DataFrame, n_buckets: int, rows_per_task: int | None = None) -> DataFrame:
    """Adds member, keep_id, keep_row, group_size. Buckets with many rows (a hot
    digest) are split evenly and get as many copies of their index row; a task
    gets about its share of all rows, 100,000 at most, unless told otherwise."""
    if rows_per_task is None:
        rows_per_task = min(100_000, max(256, -(-rows.count() // partitions(rows.sparkSession))))
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int"))
    split = materialize(keyed.groupBy("bucket").agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("split")),
                        "exact_split")
    salted = keyed.join(split, "bucket").withColumn("salt", F.pmod("row", "split").cast("int")).drop("split")
    spread = index.join(split, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("split") - 1))).drop("split")
    return (salted.groupBy("bucket", "salt").cogroup(spread.groupBy("bucket", "salt")).applyInPandas(
        lambda r, i: lookup_bucket(r, i),
        "doc_id long, row long, text_hash long, digest binary, member boolean, keep_id long, keep_row long, group_size long"))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, member, text_hash.

    With ``history`` (documents taken before) a text that history holds is a
    repeat of history's winner and is not kept. Without it, the digests that
    repeat among ``docs`` are the known ones. Rows whose digest is not known
    form groups of their own. Of repeated rows with the smallest doc_id one is
    kept; null ids come last. An empty table gives an empty result.
    """
    rows = materialize(digests(docs, id_col, text_col), "exact_rows")
    if history is None:
        known = winners(rows).where("copies > 1")
    else:
        known = winners(digests(history, id_col, text_col)).withColumn("winner_row", F.lit(-1).cast("long"))
    index, n = build_index(known)
    found = materialize(lookup(rows, index, n), "exact_found")
    new = winners(found.where("not member").select("doc_id", "row", "digest"))
    others = (found.where("not member").select("doc_id", "row", "text_hash", "digest", "member").join(new, "digest")
              .select("doc_id", "row", "text_hash", "digest", "member", F.col("winner").alias("keep_id"),
                      F.col("winner_row").alias("keep_row"), F.col("copies").alias("group_size")))
    both = found.where("member").select(others.columns).unionByName(others)
    return both.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"), "member", "text_hash")
