"""Sharding, exact dedup, line dedup and mixing against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import exact, lines, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot int, row int, digest string"


def table(spark, rows):
    """Documents with extra columns whose names clash with those the operators make."""
    full = [(i, t, "en", s, len(t or ""), 9, 9, 9, "x") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


LONG = "word " * 3000 + "end"
LINE = "This very line is in many documents, and it is long enough to count."
ROWS = ([(i, f"text {i % 7} of\tsome  kind", "a") for i in range(60)]
        + [(100 + i, f"{LINE}\nown line {i}\n  {LINE.upper()}\t", "b") for i in range(8)]
        + [(200, None, "c"), (201, "", "c"), (202, "   ", None), (203, LONG, None), (204, LONG.replace(" ", "\n"), "a"),
           (205, "é ü 漢字 \x00  x", "z"), (1, "text 1 of some kind", "a"), (1, "text 1 of some kind", "a"),
           (None, "no id", "a"), (None, "no id", "a")])


def test_shards_are_contiguous_and_balanced(spark):
    out = sharding.shard_documents(table(spark, ROWS), 4).toPandas()
    assert len(out) == len(ROWS)
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert Counter((None if pd.isna(i) else int(i), s, c) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32)) == sizes
    out = out.sort_values(["shard", "slot"])
    ids = out.doc_id.fillna(-1).tolist()
    assert ids == sorted(ids)
    total, start = int(out["size"].sum()), 0
    for size, shard in zip(out["size"], out.shard):
        assert shard == (2 * start + size) * 4 // (2 * total)
        start += size
    for _, part in out.groupby("shard"):
        assert part.slot.tolist() == list(range(len(part)))


def test_shards_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}" * (i + 1)) for i in range(50)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s")).toPandas()
    assert sorted(zip(back.doc_id, back.text)) == [(i, f"t{i}" * (i + 1)) for i in range(50)]
    assert back.shard.nunique() == 4


def test_shards_keep_columns_and_repeats(spark, tmp_path):
    rows = [(i, t, 5, 6, 7) for i, t, _ in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int, _i int").repartition(3)
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert Counter(map(str, [(r.doc_id, r.text, r.shard, r.slot, r._i) for r in back])) == Counter(map(str, rows))
    slots = defaultdict(list)
    for r in back:
        slots[r._shard].append(r._slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"), 4)


def test_empty_tables(spark):
    empty = table(spark, []).limit(0)
    assert sharding.shard_documents(empty).count() == 0
    assert exact.exact_dedup(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(spark):
    out = exact.exact_dedup(table(spark, ROWS)).toPandas()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[normal(t)].append(i)
    assert len(out) == len(ROWS)
    want = {hashlib.sha256(k.encode()).hexdigest(): (min((x for x in v if x is not None), default=None), len(v))
            for k, v in groups.items()}
    for r in out.itertuples():
        keep, size = want[r.text_sha256]
        assert r.group_size == size and (pd.isna(r.keep_id) if keep is None else r.keep_id == keep)
        if r.kept:
            assert pd.isna(r.doc_id) if keep is None else r.doc_id == keep
    assert out.groupby("text_sha256").kept.sum().eq(1).all()


def test_exact_dedup_against_history(spark):
    old = spark.createDataFrame([(7, "a b"), (3, "a  b"), (9, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a\tb"), (2, "c"), (4, "d"), (5, "d"), (6, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in exact.exact_dedup(new, old).collect()}
    assert (out[1].keep_id, out[1].kept, out[1].member) == (3, False, True)
    assert (out[2].keep_id, out[2].kept) == (9, False)
    assert (out[4].kept, out[5].kept, out[5].keep_id) == (True, False, 4)
    assert out[6].kept


def test_hot_digest_is_split(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(3000)], "doc_id long, text string")
    staged = exact.digests(rows)
    index, n = exact.build_index(exact.winners(staged).where("copies > 1"))
    found = exact.lookup(staged, index, n, rows_per_task=100).toPandas()
    assert len(found) == 3000 and found.member.sum() == 2000
    assert set(found[found.member].keep_id) == {1}


@settings(max_examples=25, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), min_size=1, max_size=400), st.sets(st.binary(min_size=7, max_size=9), max_size=50))
def test_perfect_hash(keys, others):
    def digest(x):
        return hashlib.sha256(x).digest()
    keys = sorted(keys)
    known = pd.DataFrame({"bucket": 0, "digest": [digest(k) for k in keys], "winner": range(len(keys)),
                          "winner_row": range(len(keys)), "copies": 2})
    index = exact.build_bucket(known)
    assert len(index["slots"][0]) == 32 * len(keys)          # minimal: as many slots as keys
    asked = [*keys, *sorted(others)]
    rows = pd.DataFrame({"doc_id": 0, "row": range(len(asked)), "text_hash": 0, "digest": [digest(k) for k in asked]})
    out = exact.lookup_bucket(rows, index)
    assert out.member.tolist() == [True] * len(keys) + [False] * len(others)
    assert out.keep_id[: len(keys)].tolist() == list(range(len(keys)))


def line_truth(rows, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, t, _ in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != (-1 if i is None else i))]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(spark):
    extra = [(300 + i, "\n".join([LINE, "", "x" * 45, LINE, "end"]), "a") for i in range(4)] + [(None, LINE + "\nq", "a")]
    rows = ROWS + extra
    out = lines.dedup_lines(table(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out)
    assert got == line_truth(rows)
    assert sum(r.n_dropped for r in out) > 10


def test_line_bitmaps_hold_runs(spark):
    rows = [(i, f"{LINE}\n{LINE}\nkeep {i}\n{LINE}", "a") for i in range(6)]
    maps = {r.doc_id: [tuple(x) for x in r.dropped_runs] for r in lines.line_bitmaps(table(spark, rows)).collect()}
    assert maps == {i: [(0, 2), (3, 1)] for i in range(5)}       # document 5 keeps its lines


def fill(sizes, weights, total, cap=2.0):
    target, open_ = {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > cap * sizes[s]}
        if not over:
            target.update({s: weights[s] * level for s in open_})
            break
        target.update({s: cap * sizes[s] for s in over})
        open_ -= over
    return target


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 60)), s) for i, s in enumerate(
        ["hot"] * 300 + ["a"] * 50 + ["é"] * 30 + ["Z"] * 20 + [None] * 40 + ["none"] * 1)]
    rows += [(900, None, "only null"), (901, "", "only null")]
    docs = table(spark, rows)
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()))
    for s, part in out.groupby(out.source.fillna("<null>")):
        s = None if s == "<null>" else s
        assert part.source_size.iloc[0] == sizes[s]
        assert part.target.iloc[0] == pytest.approx(want[s])
        assert abs(part.taken.sum() - want[s]) <= 1            # some subset of so many lengths fits
        assert (part.taken <= 2 * part["size"]).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 6)), min_size=1, max_size=12, unique_by=lambda x: x[0]), st.data())
def test_subset_sum_is_as_near_as_possible(pairs, data):
    lengths, counts = (np.array(x, np.int64) for x in zip(*pairs))
    budget = data.draw(st.integers(0, int((lengths * counts).sum())))
    take = mixing.fit_counts(lengths, counts, budget)
    reach = {0}
    for size, n in pairs:
        reach = {r + size * k for r in reach for k in range(n + 1)}
    assert (take >= 0).all() and (take <= counts).all()
    assert int((take * lengths).sum()) == max(r for r in reach if r <= budget)
