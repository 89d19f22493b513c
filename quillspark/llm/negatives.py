"""Hard negatives: exact integer scores from products of residue matrices, score windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import partitions
from quillspark.session import ship_package
from quillspark.sinks.snapshots import materialize

SLICE = 64              # components in one float32 product
ROWS = 8192             # rows of a block
ANCHORS = 2048          # anchors of a block
TILE = 128              # anchors scored at once against a block of rows
MAX_NORM = float(2 ** 62)       # largest squared norm whose scores fit a long
NO_ID = 2 ** 63 - 1     # stands for a null id, behind all others


def moduli(bound: float) -> list[int]:
    """The largest primes whose centred residues give float32 products that are
    exact over ``SLICE`` components, as many as tell all integers up to ``bound``
    in size apart."""
    out, product, p = [], 1, 1023
    while product <= 2 * bound + 1:
        if SLICE * (p // 2) ** 2 < 2 ** 24 and all(p % q for q in range(3, int(p ** 0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues of an integer matrix, one float32 matrix per prime."""
    out = []
    for p in primes:
        r = np.mod(x, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed integer products of all rows of ``a`` and ``b``, given by residues.

    Every product over ``SLICE`` components is exact in float32. Chinese
    remaindering runs digit by digit with centred digits, so the sum of the
    digits is the signed score itself.
    """
    total, unit = np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for p, ra, rb in zip(primes, a, b):
        r = np.zeros(total.shape, np.int32)
        for s in range(0, ra.shape[1], SLICE):
            r = (r + (ra[:, s: s + SLICE] @ rb[:, s: s + SLICE].T).astype(np.int32)) % p
        digit = (r - total % p) * pow(unit, -1, p) % p
        total += np.where(digit > p // 2, digit - p, digit) * unit
        unit *= p
    return total


def best(score: np.ndarray, ok: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of each anchor's first ``k`` rows: higher score, then smaller id."""
    n = score.shape[1]
    if n > k:
        s = np.where(ok, score, np.iinfo(np.int64).min)
        ok = ok & (s >= np.partition(s, n - k, axis=1)[:, n - k][:, None])
    at, row = np.nonzero(ok)
    order = np.lexsort((rows[row], ids[row], -score[at, row], at))
    at, row = at[order], row[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    return at[nth < k], row[nth < k]


def windowed(score: np.ndarray, ok: np.ndarray, ids: np.ndarray, rows: np.ndarray, owner: np.ndarray,
             low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (window, row) of the first ``k`` rows of each window: the rows of anchor
    ``owner`` whose score lies from ``low`` to ``high``. Windows and candidates are
    sorted together; a window's rows are those that follow it."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, most = np.full(len(score), np.iinfo(np.int64).max), np.full(len(score), np.iinfo(np.int64).min)
    np.minimum.at(least, owner, low)
    np.maximum.at(most, owner, high)
    at, row = np.nonzero(ok & (score >= least[:, None]) & (score <= most[:, None]))
    if not len(at):
        return at, row
    s, n = score[at, row], len(owner)
    none = np.zeros(n, np.int64)
    order = np.lexsort((np.concatenate([none, rows[row]]), np.concatenate([none, ids[row]]),
                        np.concatenate([none, none[:1].repeat(len(at)) + 1]),
                        -np.concatenate([high, s]), np.concatenate([owner, at])))
    is_row = order >= n
    sorted_rows, window = order[is_row] - n, order[~is_row]
    take = (np.cumsum(is_row)[~is_row])[:, None] + np.arange(k)
    inside = take < len(sorted_rows)
    pick = sorted_rows[np.minimum(take, len(sorted_rows) - 1)]
    inside &= (at[pick] == owner[window][:, None]) & (s[pick] >= low[window][:, None])
    return np.broadcast_to(window[:, None], pick.shape)[inside], row[pick[inside]]


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` / 100 of each score, rounded up or down, without overflow."""
    q, r = np.divmod(score, 100)
    return percent * q + (-(-percent * r // 100) if up else percent * r // 100)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as an integer matrix; shorter vectors are filled up with 0."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _sides(cell: pa.Table, dim: int) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """Anchors and rows of a cell and their vectors."""
    anchor = cell.column("side").to_numpy() == 0
    a, r = cell.filter(pa.array(anchor)), cell.filter(pa.array(~anchor))
    return a, r, _matrix(a.column("v"), dim), _matrix(r.column("v"), dim)


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _positives(primes: list[int], dim: int, k: int):
    def run(cell: pa.Table) -> pa.Table:
        anchors, rows, va, vr = _sides(cell, dim)
        arow, alabel = _numbers(anchors, "row", "label")
        rid, rrow, rlabel = _numbers(rows, "id", "row", "label")
        out = []
        for label in np.unique(alabel):
            mine, theirs = np.flatnonzero(alabel == label), np.flatnonzero(rlabel == label)
            if not len(theirs):
                continue
            right = residues(vr[theirs], primes)
            for start in range(0, len(mine), TILE):
                tile = mine[start: start + TILE]
                score = scores(residues(va[tile], primes), right, primes)
                at, row = best(score, arow[tile][:, None] != rrow[theirs][None, :], rid[theirs], rrow[theirs], k)
                out.append((arow[tile][at], rid[theirs][row], rrow[theirs][row], score[at, row]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "id", "row", "score"])
    return run


def _negatives(primes: list[int], dim: int, k: int, low: int, high: int):
    def run(cell: pa.Table) -> pa.Table:
        anchors, rows, va, vr = _sides(cell, dim)
        arow, alabel = _numbers(anchors, "row", "label")
        rid, rrow, rlabel = _numbers(rows, "id", "row", "label")
        right, out = residues(vr, primes), []
        lists = anchors.column("positives").combine_chunks()
        owners = np.repeat(np.arange(len(arow)), lists.value_lengths().to_numpy(zero_copy_only=False))
        targets = lists.flatten().to_numpy(zero_copy_only=False)
        nth = np.arange(len(owners)) - np.searchsorted(owners, owners)
        bottom, top = share(targets, low, True), share(targets, high, False)
        for start in range(0, len(arow) if len(rrow) else 0, TILE):
            tile = slice(start, start + TILE)
            score = scores(residues(va[tile], primes), right, primes)
            w = np.flatnonzero((owners >= start) & (owners < start + TILE) & (bottom <= top))
            window, row = windowed(score, alabel[tile][:, None] != rlabel[None, :], rid, rrow, owners[w] - start,
                                   bottom[w], top[w], k)
            window = w[window]
            out.append((arow[owners[window]], nth[window], rid[row], rrow[row], score[owners[window] - start, row]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "nth", "id", "row", "score"])
    return run


def _block(count, size: int):
    return F.pmod(F.xxhash64("row"), F.greatest(F.ceil(count / size), F.lit(1))).cast("int")


def _blocks(count, size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(count / size), F.lit(1)).cast("int") - 1))


def hard_negatives(vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50,
                   high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """Negatives that score close below a positive: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    ``anchor`` is a condition on ``vectors`` that marks the anchors. A component x
    counts as floor(scale * x); a row's score is its integer inner product with the
    anchor; higher scores come first, ties by smaller id. An anchor's positives are
    its first ``n_positives`` other rows of the same label. Each of them gets the
    first ``n_negatives`` rows of other labels that score from ``low`` to ``high``
    percent of it, ranked from 1.

    Rows and anchors are hashed into blocks; a task scores one block of anchors
    against one block of rows (the positives only where labels agree) and gives
    its first few of each anchor or window, which are merged. A frequent label is
    cut into blocks like all others, rare ones share cells. Scores are exact: see
    ``scores``; the number of primes follows from the largest norm.

    Rows with a null label or vector, with a null or non-finite component, or with
    a squared norm over 2^62 (scores would leave the long range) take no part.
    Vectors of unequal length are filled up with zeros. Null ids stand behind all
    others. Repeated rows are rows of their own: each is the other's positive, and
    a repeated anchor gives its rows again. Where windows hold fewer rows, all are
    given; an empty table gives an empty result. Other columns are not read, so
    their names don't matter.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    v, inf = F.col(vector_col).cast("array<double>"), float("inf")
    raw = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"),
                         v.alias("x"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    sound = (raw.where(F.col("label").isNotNull() & F.col("x").isNotNull())
             .where(F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < inf), F.lit(False))))
             .withColumn("norm", F.aggregate("x", F.lit(0.0), lambda s, c: s + F.pow(F.floor(c * scale).cast("double"), 2)))
             .where(F.col("norm") <= MAX_NORM))
    rows = materialize(sound.select("id", "label", "is_anchor", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"),
                                    "norm", F.monotonically_increasing_id().alias("row")), "negative_rows")
    count, anchors, dim, norm = rows.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("v")), F.max("norm")).first()
    primes = moduli((norm or 0.0) * 1.001)
    dim = max(dim or 0, 1)
    n = partitions(spark)

    # Positives: blocks of one label; labels that fit one block share cells by hash.
    per_label = rows.groupBy("label").agg(F.count("*").alias("held"), F.count_if("is_anchor").alias("asked")).where("asked > 0")
    placed = rows.select("id", "row", "label", "v", "is_anchor").join(per_label, "label").withColumn(
        "small", (F.col("held") <= ROWS) & (F.col("asked") <= ANCHORS))
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(max(1, -(-count // ROWS)))))

    def cell(i, j):
        return F.when(F.col("small"), shared).otherwise(F.concat_ws("_", "label", i, j))

    width = F.when(F.col("small"), 1).otherwise(F.col("asked")), F.when(F.col("small"), 1).otherwise(F.col("held"))
    right = (placed.withColumn("i", _block(F.col("held"), ROWS)).withColumn("j", _blocks(width[0], ANCHORS))
             .select(cell("i", "j").alias("cell"), F.lit(1).alias("side"), "id", "row", "label", "v"))
    left = (placed.where("is_anchor").withColumn("j", _block(F.col("asked"), ANCHORS)).withColumn("i", _blocks(width[1], ROWS))
            .select(cell("i", "j").alias("cell"), F.lit(0).alias("side"), "id", "row", "label", "v"))
    near = (right.unionByName(left).repartition(n, "cell").groupBy("cell")
            .applyInArrow(_positives(primes, dim, n_positives), "anchor long, id long, row long, score long"))
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    positives = materialize(near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= n_positives)
                            .select("anchor", (F.col("nth") - 1).alias("nth"), "id", "score"), "negative_positives")

    # Negatives: all blocks of rows against the anchors' windows.
    targets = positives.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("p"))
    asking = rows.where("is_anchor").join(targets, "row").select("id", "row", "label", "v", F.col("p.score").alias("positives"))
    right = (rows.withColumn("i", _block(F.lit(count), ROWS)).withColumn("j", _blocks(F.lit(anchors), ANCHORS))
             .select("i", "j", F.lit(1).alias("side"), "id", "row", "label", "v", F.lit(None).cast("array<long>").alias("positives")))
    left = (asking.withColumn("j", _block(F.lit(anchors), ANCHORS)).withColumn("i", _blocks(F.lit(count), ROWS))
            .select("i", "j", F.lit(0).alias("side"), "id", "row", "label", "v", "positives"))
    found = (right.unionByName(left).repartition(n, "i", "j").groupBy("i", "j")
             .applyInArrow(_negatives(primes, dim, n_negatives, low, high), "anchor long, nth long, id long, row long, score long"))
    ranked = (found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id", "row")))
              .where(F.col("rank") <= n_negatives))

    def given(c: str) -> Column:
        return F.when(F.col(c) != NO_ID, F.col(c))

    asked = rows.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    target = positives.select("anchor", F.col("nth").cast("long").alias("nth"), F.col("id").alias("positive_id"),
                              F.col("score").alias("positive_score"))
    return (ranked.join(target, ["anchor", "nth"]).join(asked, "anchor")
            .select(given("anchor_id").alias("anchor_id"), given("positive_id").alias("positive_id"), "rank",
                    given("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
