"""Near duplicates of texts and of embeddings against brute force."""

import numpy as np
import pytest

from quillspark.llm import embed, graph, minhash


def words_of(text):
    return (text or "").encode().lower().split()


def truth(rows):
    """Smallest doc_id of each document's component, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def corpus():
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(3000)]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(1, 200)))) for i in range(120)]
    original = list(rng.choice(vocab, 150))
    for k in range(150):                       # a large family of copies with few to many edits
        copy = original.copy()
        for at in rng.integers(0, 150, rng.integers(0, 9)):
            copy[at] = str(rng.choice(vocab))
        rows.append((1000 + k, " ".join(copy)))
    for k in range(30):                        # pairs
        base = list(rng.choice(vocab, 80))
        rows += [(2000 + 2 * k, " ".join(base)), (2001 + 2 * k, " ".join(base[: 80 - k % 12]) + (" tail" * (k % 3)))]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "One two"), (3004, "one  TWO"), (3005, "one two three"),
             (3006, "x " * 20000), (3007, "X " * 15000), (3008, "É é"), (3009, "é é")]
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, cid int, sketch string").repartition(4)
    out = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    want = truth(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in out.items())
    assert sum(not r.kept for r in out.values()) > 100


def test_near_duplicates_edge_rows(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    same = "a b c d e f g"
    rows = minhash.near_duplicates(spark.createDataFrame([(5, same), (5, same), (None, same), (None, "q"), (8, None)], schema)).collect()
    family = [r for r in rows if r.n_shingles == 3]
    assert [r.component_id for r in family] == [5, 5, 5] and sum(r.kept for r in family) == 1
    assert [r.kept for r in rows if r.n_shingles < 3] == [True, True]


@pytest.mark.parametrize("n", [1, 3, 40, 2000])
def test_sketches_estimate_similarity(n):
    rng = np.random.default_rng(n)
    both, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (3 * n, n, n))
    sets = [np.sort(np.concatenate([both, a])), np.sort(np.concatenate([both, b])), np.sort(both)]
    sk = minhash.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    assert abs((sk[0] == sk[1]).mean() - 0.6) < 0.15          # 3n of 5n
    assert abs((sk[0] == sk[2]).mean() - 0.75) < 0.13


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 100), (5, 3), (5, 3)]
    out = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert len({out[i] for i in range(41)}) == 1 and len({out[i] for i in (100, 101, 102, 200)}) == 1
    assert out[0] != out[100]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(300)]
    base = rng.normal(size=16)
    rows += [(1000 + k, (base + rng.normal(size=16) * 0.13).tolist(), 1) for k in range(700)]   # more than a block
    rows += [(2000 + k, (2.0 * base).tolist(), 1) for k in range(5)] + [(2100, base.tolist(), 2)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + [1.0] * 15, 1), (3003, [None] + [1.0] * 15, 1),
             (3004, [float("inf")] + [1.0] * 15, 1), (3005, base.tolist(), None), (3006, [], 1), (3007, [1.0, 2.0], 1),
             (3008, [2.0, 4.0], 1), (3009, (1e200 * base).tolist(), 0), (3010, (1e-200 * base).tolist(), 0)]
    return rows


def test_embeddings_against_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame([(i, v, c, 1) for i, v, c in rows], "vec_id long, embedding array<double>, label int, cid int")
    out = {r.vec_id: r for r in embed.embedding_duplicates(frame.repartition(4)).collect()}
    assert len(out) == len(rows)
    good = [(i, np.array(v, float), c) for i, v, c in rows if c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = [embed.unit(v[None, :])[0] for _, v, _ in good]
    links, parent = {i: 0 for i, _, _ in good}, {i: i for i, _, _ in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x in range(len(good)):
        for y in range(x):
            if good[x][2] == good[y][2] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= 0.98:
                for k in (x, y):
                    links[good[k][0]] += 1
                a, b = sorted((find(good[x][0]), find(good[y][0])))
                parent[b] = a
    found, real = sum(r.n_links for r in out.values()), sum(links.values())
    assert real > 10_000 and 0.9 * real <= found <= real
    assert all(out[i].n_links <= n for i, n in links.items())
    right = sum(out[i].component_id == find(i) for i in links)
    assert right >= 0.99 * len(links)
    for i in (3000, 3001, 3002, 3003, 3004, 3005, 3006):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert out[3008].component_id == 3007 and out[3010].component_id == 3009


def test_embeddings_edge_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embed.embedding_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = embed.embedding_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], schema)).collect()
    assert [r.n_links for r in rows] == [2, 2, 2] and sum(r.kept for r in rows) == 1
    assert {r.component_id for r in rows} == {1}
