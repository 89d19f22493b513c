"""Hard negatives against plain integer loops."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import negatives


def brute(rows, scale=256, n_pos=5, n_neg=3, low=50, high=95, every=5):
    sound = []
    for r, (i, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * x) for x in v]
        if sum(x * x for x in q) <= 2 ** 62:
            sound.append((r, i, label, q))
    key = lambda t: (-t[0], t[1] is None, t[1], t[2])     # noqa: E731
    out = []
    for r, i, label, q in sound:
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, p)), j, k, other) for k, j, other, p in sound if k != r]
        for s, j, _, _ in sorted((t for t in scored if t[3] == label), key=key)[:n_pos]:
            found = sorted((t for t in scored if t[3] != label and low * s <= 100 * t[0] <= high * s), key=key)[:n_neg]
            out += [(i, j, n + 1, t[1], s, t[0]) for n, t in enumerate(found)]
    return sorted(out, key=str)


KIND = "vec_id long, label int, embedding array<float>, row int, side string, cell int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND).repartition(3)


def mined(spark, rows, **kw):
    return sorted(map(tuple, negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0, **kw).collect()), key=str)


def vectors(n, dim, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dim)
    x = (rng.normal(size=(n, dim)) * spread + centre).astype(np.float32)
    return [(i, int(rng.integers(labels)), [float(c) for c in v]) for i, v in enumerate(x)]


def test_matches_plain_loops(spark):
    rows = vectors(160, 20, 4, 1)
    assert mined(spark, rows) == brute(rows) != []


def test_small_blocks_and_hot_label(spark, monkeypatch):
    """One label holds most rows; blocks are far smaller than it."""
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rows = [(i, 0 if i % 3 else label, v) for i, label, v in vectors(150, 8, 6, 2)]
    assert mined(spark, rows) == brute(rows) != []


def test_ties_repeats_nulls_and_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, i % 2, [1.0, 0.5 if i % 3 else 0.25]) for i in range(30)]
    rows += [(5, 1, [1.0, 0.5]), (5, 1, [1.0, 0.5]), (None, 0, [1.0, 0.5]), (None, 1, [0.9, 0.5]), (40, None, [1.0, 0.5]), (45, 1, None),
             (50, 1, [1.0, None]), (55, 0, [inf, 0.0]), (60, 0, [nan, 0.0]), (65, 0, []), (70, 1, [1.0]), (75, 1, [1.0, 0.5, 2.0]),
             (80, 0, [-1.0, -0.5]), (85, 2, [0.0, 0.0]), (90, 0, [1e30, 0.0])]
    got, want = mined(spark, rows), brute(rows)
    assert got == want != []


def test_empty_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []


@pytest.mark.parametrize("size,dim", [(1.0, 3), (300.0, 200), (5e5, 130), (2e6, 30)])
def test_scores_are_exact(size, dim):
    rng = np.random.default_rng(3)
    a, b = (np.floor(256 * size * rng.uniform(-1, 1, (40, dim))).astype(np.int64) for _ in range(2))
    norm = max(float((x.astype(float) ** 2).sum(axis=1).max()) for x in (a, b))
    assert norm <= negatives.MAX_NORM
    primes = negatives.moduli(norm * 1.001)
    got = negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    assert got.tolist() == [[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-40, 40), min_size=1, max_size=30), st.lists(st.tuples(st.integers(-40, 40), st.integers(-40, 40)), max_size=5))
def test_windows_match_sorting(values, windows):
    score = np.array([values, values[::-1]])
    n = len(values)
    ids, rows = np.arange(n) // 2, np.arange(n)[::-1].copy()
    owner = np.arange(len(windows)) % 2
    low, high = np.array([w[0] for w in windows], np.int64), np.array([w[1] for w in windows], np.int64)
    keep = low <= high
    w, r = negatives.windowed(score, np.ones(score.shape, bool), ids, rows, owner[keep], low[keep], high[keep], 3)
    got = sorted(zip(w.tolist(), r.tolist()))
    want = []
    for k, (o, a, b) in enumerate(zip(owner[keep], low[keep], high[keep])):
        order = sorted((j for j in range(n) if a <= score[o, j] <= b), key=lambda j: (-score[o, j], ids[j], rows[j]))
        want += [(k, j) for j in order[:3]]
    assert got == sorted(want)


def test_shares_round_like_integers():
    s = np.array([-(2 ** 62), -101, -100, -1, 0, 1, 19, 20, 21, 99, 2 ** 62])
    for p in (50, 95, 100, 0):
        assert negatives.share(s, p, True).tolist() == [-(-p * int(x) // 100) for x in s]
        assert negatives.share(s, p, False).tolist() == [p * int(x) // 100 for x in s]
