"""Parts of the classifiers against plain loops, and the licence scan against its SQL."""

import math
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import license_texts, licenses, lines, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_pair_loss_equals_a_double_loop(monkeypatch):
    monkeypatch.setattr(quality, "PAIR_BLOCK", 7)
    rng = np.random.default_rng(4)
    z, w, ridge = rng.normal(size=(12, 3)), rng.normal(size=3), 0.1
    i, j = rng.integers(0, 12, 40), rng.integers(0, 12, 40)

    def plain(v):
        total = 0.0
        for a, b in zip(i, j):
            total += math.log1p(math.exp(-sum(v[k] * (z[a][k] - z[b][k]) for k in range(3))))
        return total / len(i) + ridge / 2 * sum(x * x for x in v)
    loss, grad, hess = quality.pair_loss(z, i, j, w, ridge)
    assert loss == pytest.approx(plain(w))
    step = 1e-5 * np.eye(3)
    assert grad == pytest.approx([(plain(w + s) - plain(w - s)) / 2e-5 for s in step], abs=1e-7)
    slopes = [(quality.pair_loss(z, i, j, w + s, ridge)[1] - quality.pair_loss(z, i, j, w - s, ridge)[1]) / 2e-5 for s in step]
    assert hess == pytest.approx(np.array(slopes), abs=1e-6)


def test_ranking_stands_at_the_least_loss():
    rng = np.random.default_rng(1)
    x, label = rng.normal(size=(60, 4)), np.repeat([0, 1], 30)
    x[label == 1, 0] += 1
    model = quality.fit_pairs(x, label, np.ones(60), ridge=0.05)
    draw = np.random.default_rng(3)
    good, bad = np.arange(30, 60), np.arange(30)
    n = quality.PAIRS_PER_ROW
    i = np.concatenate([np.repeat(good, n), draw.choice(good, 30 * n)])
    j = np.concatenate([draw.choice(bad, 30 * n), np.repeat(bad, n)])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.abs(quality.pair_loss(z, i, j, model.weights, 0.05)[1]).max() < 1e-6
    assert model.cut == pytest.approx(quality.quantile_cut(z @ model.weights, np.ones(60), 0.5))


def test_cut_is_the_quantile_of_the_sorted_worths():
    rng = np.random.default_rng(2)
    for n, share in ((1, 0.5), (2, 0.5), (9, 1 / 3), (20, 0.25), (20, 0.999)):
        worth, weight = rng.integers(0, 6, n).astype(float), rng.integers(1, 4, n)
        flat = sorted((v, k) for k, (v, m) in enumerate(zip(worth, weight)) for _ in range(m))
        inside = [k for k in dict.fromkeys(k for _, k in flat)
                  if max(p for p, x in enumerate(flat) if x[1] == k) + 1 <= share * len(flat) + 1e-9]
        ordered = [worth[k] for k in sorted(range(n), key=lambda k: (worth[k], k))]
        at = min(len(inside), n - 1)
        assert quality.quantile_cut(worth, weight.astype(float), share) == pytest.approx((ordered[max(0, at - 1)] + ordered[at]) / 2)


def test_grams_equal_plain_counts(monkeypatch):
    monkeypatch.setattr(quality, "TEXT_BLOCK", 5)
    for text in ("", "a", "ab", "abc", "Some words, some WORDS\nand é漢🙂 " * 3, " \n\t "):
        raw, words = text.encode(), text.split()
        tri = Counter(((int.from_bytes(raw[k:k + 3], "big") * 2654435761) % 2 ** 32 >> 16) % quality.BUCKETS for k in range(len(raw) - 2))
        word = Counter(crc32(w.lower().encode()) % quality.BUCKETS for w in words)
        want = ([math.sqrt(tri[k] / max(1, len(raw) - 2)) for k in range(quality.BUCKETS)]
                + [math.sqrt(word[k] / max(1, len(words))) for k in range(quality.BUCKETS)])
        assert quality.grams(text, quality.WordBuckets()) == pytest.approx(want)


def plain_lexicon(rows):
    sizes = Counter(label for _, label in rows)
    docs, uses = Counter(), Counter()
    for text, label in rows:
        here = Counter()
        for token, n in Counter(text.split()).items():
            for t in toxicity.terms(token):
                here[t] += min(n, 5)
        for t, n in here.items():
            docs[t, label] += 1
            uses[t, label] += n
    n1, n0 = sizes[1], sizes[0]

    def odds(a, b):
        return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    found = []
    for term in {t for t, _ in docs}:
        a, b = uses[term, 1], uses[term, 0]
        if docs[term, 1] < min(toxicity.MIN_DOCS, max(2, n1 // 20)) or odds(a, b) <= 1:
            continue
        if term.endswith("*"):
            own = {t for t, _ in docs if t.startswith(term[:-1]) and not t.endswith("*")}
            top = max(own, key=lambda w: (uses[w, 1], -uses[w, 0]))
            if a == uses[top, 1] or odds(a - uses[top, 1], b - uses[top, 0]) <= 1:
                continue
        found.append((-(a * odds(a, b) - (a - b)), term, min(odds(a, b), 6.0)))
    return {term: value for _, term, value in sorted(found)[:toxicity.LEXICON]}


def test_lexicon_equals_plain_counts(spark):
    rng = np.random.default_rng(5)
    clean, bad = [f"word{k}" for k in range(40)], [f"fool{k}" for k in range(6)] + ["nitwit", "Oaf!"]
    rows = [(" ".join([*rng.choice(clean, 12), *rng.choice(bad, 2)]), 1) for _ in range(60)]
    rows += [(" ".join([*rng.choice(clean, 14), *(["oaf"] if k % 20 == 0 else [])]), 0) for k in range(200)] + [("", 0), ("x " * 5000, 1)]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(3))
    want = plain_lexicon(rows)
    assert got == pytest.approx(want) and {"fool*", "nitwit", "oaf"} <= set(got) and "nitw*" not in got


def test_toxicity_features_equal_plain_counts():
    lexicon = {"idiot": 3.0, "fool*": 2.0}
    for text in ("You are an IDIOT, fool!", "plain words only", "idiot " * 5 + "they said w0rd f#ck",
                 "one two three four you five six seven fools", "é漢 du bist foolish!!! $$"):
        tokens = text.split()
        own = [max((lexicon.get(t, 0.0) for t in toxicity.terms(x)), default=0.0) for x in tokens]
        you = [x.lower().strip(toxicity.EDGE) in toxicity.SECOND_PERSON for x in tokens]
        near = [any(you[max(0, k - 3): k + 4]) for k in range(len(tokens))]
        word = [x.lower().strip(toxicity.EDGE) for x in tokens]
        hidden = [not o and not y and bool(w) and w[0].isalpha() and w[-1].isalpha() and not all(c.isalpha() or c in "'-" for c in w)
                  for o, y, w in zip(own, you, word)]
        raw, n, hits = text.encode(), len(tokens), sum(o > 0 for o in own)
        upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
        want = [hits / n, sum(own) / n, max(own), len({t for t, o in zip(tokens, own) if o}) / n, math.log1p(hits),
                sum(o > 0 and m for o, m in zip(own, near)) / n, sum(you) / n, upper / max(1, upper + lower),
                sum(33 <= c <= 47 or 58 <= c <= 64 for c in raw) / len(raw), raw.count(b"!") / len(raw),
                sum(c in b"#$%&" for c in raw) / len(raw), sum(hidden) / n, math.log1p(n)]
        assert toxicity.features(text, toxicity._TokenWeights(lexicon)) == pytest.approx(want)


def test_calibration_pools_adjacent_violators(spark):
    rng = np.random.default_rng(6)
    margin = np.round(rng.normal(size=80), 1)
    rows = [(float(m), float(rng.integers(1, 4)), int(rng.random() < 1 / (1 + math.exp(-2 * m)))) for m in margin]
    pools = []
    for m in sorted(set(margin)):
        same = [(w, label) for x, w, label in rows if x == m]
        pools.append([sum(w * label for w, label in same), sum(w for w, _ in same), [m]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a, b, ms = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + ms]
    want = {m: a / b for a, b, ms in pools for m in ms}
    df = spark.createDataFrame(rows, "margin double, weight double, label int")
    got = {r.margin: r.prediction for r in toxicity.calibration(df).transform(df).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name, column, score", [("quality", "quality", quality.quality_scores), ("toxic", "toxic", toxicity.toxicity_scores)])
def test_held_out_precision_and_recall(spark, name, column, score):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = dict(duckdb.sql(f"select doc_id, {column} from '{SF}/labels.parquet'").fetchall())
    held = [(r.predicted, truth[r.doc_id]) for r in score(docs, labels).where("held_out").collect() if r.doc_id in truth]
    both, said, true = sum(p == t == 1 for p, t in held), sum(p for p, _ in held), sum(t for _, t in held)
    assert true > 3 and both / said > 0.85 and both / true > 0.75


def test_toxicity_does_not_learn_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity_scores(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_sql_of_the_scan_follows_its_rule(spark, tmp_path):
    mit, isc = licenses.KNOWN_TEXTS[0][1], licenses.KNOWN_TEXTS[1][1]
    rows = [mit, "MIT License\n\nCopyright (c) 2020 A\n\n" + mit, "ISC License\n\n" + isc, "Copyright 20000 copies\n" + isc, None, "", "plain",
            "Released under the MIT license.\nLicensed under CC BY 4.0!", "x\n(c) You must retain, in the Source form\ny",
            "(C) 2011 C\nbody", "copyright 2020", "Copyright of all. All rights reserved. \t\nbody", "Copyright of all rights reserved x\nbody",
            "all rights reserved.\nbody", "Copyright [yyyy] [name of copyright owner]\nbody", "© 20201 x\n©, 2020, y\nthe organisation",
            "COPYRIGHT HOLDERS BE LIABLE\nfor the sub licence", "(c) Copyright 2001 F\n\n(c) {{ year }} z\n© Copyright"]
    rows += [t for i in ("GPL-3.0-only", "Apache-2.0", "MPL-2.0") for t in ("\n".join(license_texts.published(i)), license_texts.published(i)[1])]
    rows += [" ".join(mit.split()[k:]) for k in range(3)] + [f"copyright {'(c) ' * k}19{k}9{'9' * (k % 2)} who\nrest" for k in range(8)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    got = {tuple(r) for r in licenses.scan_licenses(docs).select("doc_id", "text_digest", "license_id", "line_licenses").collect()}
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = set(db.sql(queries.ORACLES["op2_licenses"]).fetchall())
    assert got == want and sum(r[2] is not None for r in got) >= 9
    plain = [licenses.plain_canonical(t or "") for t in rows]
    assert [r.c for r in docs.orderBy("doc_id").select(licenses.canonical(F.coalesce("text", F.lit(""))).alias("c")).collect()] == plain
    digests = {r.digest: r.license_id for r in licenses.known_digests(spark).collect()}
    assert licenses.plain_digests() == digests


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_slices_do_not_change_the_dropped_lines(spark, slices):
    line, rare = "This line stands in very many documents of the table.", "This one stands in only four of the documents here."
    docs = spark.createDataFrame([(k if k % 50 else None, f"own {k}\n{line}\n" + (rare if k < 4 else line)) for k in range(300)],
                                 "doc_id long, text string").repartition(7)
    got = sorted((r.doc_id or -1, r.pos) for r in lines.repeated_lines(docs, slices=slices).collect())
    want = sorted((k if k % 50 else -1, p) for k in range(299) for p in ((1,) if k < 4 else (1, 2)))
    assert got == want
    with pytest.raises(ValueError):
        lines.repeated_lines(docs, slices=65)
