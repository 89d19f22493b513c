"""Tokenizer, licence, quality, toxicity and the pipeline."""

from collections import Counter
import base64
import hashlib
import re
import textwrap

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillspark.llm import bpe, license_texts, licenses, quality, toxicity

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = np.random.default_rng(2)
    alphabet = list("ab c  \n\t'sre1 23!?é漢🙂,.") + ["'ll", "   ", " ", "can't "]
    out = [None, "", " ", "hello world", "<|endoftext|>", "a" * 400, " " * 300, "\n" * 100 + "x", "1" * 250 + " b" * 90]
    return out + ["".join(rng.choice(alphabet, n)) for n in (5, 60, 61, 62, 100, 333, 1000, 2500) for _ in range(6)]


def test_chunked_encoding_equals_the_library(spark, encoder):
    rows = list(enumerate(texts())) + [(3, "hello again"), (None, "no id, " * 40)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, ids string").repartition(3)
    ids = bpe.encode(docs, chunk=50, overlap=12)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in ids.collect())
    want = sorted((i is None, i or 0, encoder.encode_ordinary(t or "")) for i, t in rows)
    assert got == want
    back = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in bpe.decode(ids).collect())
    assert back == sorted((i is None, i or 0, (t or "").encode()) for i, t in rows)


def test_long_texts_resynchronise(spark, encoder):
    long = "".join(np.random.default_rng(0).choice(["word ", "don't ", "x\n\n", "  ", "42", "é!"], 90_000))
    assert len(long) > 3 * bpe.CHUNK
    docs = spark.createDataFrame([(1, long), (2, "a" * 70_000 + " b"), (3, "short")], "doc_id long, text string")
    out = {r.doc_id: r for r in bpe.encode_digests(docs).collect()}
    for i, t in ((1, long), (3, "short")):
        ids = encoder.encode_ordinary(t)
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert out[2].decoded_sha256 == hashlib.sha256(b"a" * 70_000 + b" b").hexdigest()


def test_a_missed_seam_joins_its_neighbours_only(spark, encoder):
    """One pre-token over several chunks: the other chunks of the text stay pieces of their own."""
    rng = np.random.default_rng(5)

    def words(n):
        return "".join(rng.choice(["word ", "don't ", "42 ", "é! "], n))
    rows = [(1, words(100) + " " + "x" * 700 + " " + words(100)), (2, words(100) + "7" * 230 + words(50) + "y" * 130 + words(30)),
            (3, "z" * 2000), (None, words(300)), (3, "z" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = bpe._share(docs, None)
    chunks = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", F.char_length("text").alias("_len")) \
        .withColumn("_n", F.explode(F.sequence(F.lit(0), F.ceil((F.col("_len") - 20) / 100).cast("int") - 1))) \
        .select("doc_id", "row", "_n", "_len", (F.col("_n") * 100).alias("_start"), F.substring("text", F.col("_n") * 100 + 1, F.lit(120)).alias("_chunk"))
    pieces = bpe._pieces(chunks, shared, 100, 20)
    sizes = {r.row: sorted(p[0] for p in r.p) for r in pieces.groupBy("row").agg(
        F.collect_list(F.struct(F.col("_to") - F.col("_n") + 1)).alias("p")).collect()}
    first = sizes[docs.select(F.monotonically_increasing_id().alias("r"), "doc_id").where("doc_id = 1").first().r]
    assert first[-1] in (7, 8, 9) and set(first[:-1]) == {1} and len(first) > 5
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in bpe.encode(docs, chunk=100, overlap=20).collect())
    assert got == sorted((i is None, i or 0, encoder.encode_ordinary(t)) for i, t in rows)


def test_false_boundaries_are_not_stitched(spark, tmp_path):
    """Digits in threes: chunks of 99 digits agree with each other, not with where the run began."""
    ranks = tmp_path / "bytes.tiktoken"
    ranks.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256))
                      + b"\n" + b"\n".join(base64.b64encode(b) + b" %d" % (256 + k) for k, b in enumerate((b"12", b"123", b"31", b"23"))))
    pattern = r"\p{N}{1,3}|[^\p{N}]+"
    text = "ab" + "123" * 300 + "c" + "231" * 100 + "12"
    docs = spark.createDataFrame([(1, text), (2, "x" + text)], "doc_id long, text string")
    plain = tiktoken.Encoding("own", pat_str=pattern, special_tokens={}, mergeable_ranks=bpe.load_ranks(ranks.read_bytes()))
    got = {r.doc_id: r.ids for r in bpe.encode(docs, vocabulary=(str(ranks), pattern), chunk=99, overlap=20).collect()}
    assert got == {1: plain.encode_ordinary(text), 2: plain.encode_ordinary("x" + text)}


def test_pieces_are_dealt_out_before_encoding(spark):
    docs = spark.createDataFrame([(1, "word " * 20_000)], "doc_id long, text string")
    plan = bpe.encode(docs)._jdf.queryExecution().executedPlan().toString().splitlines()
    encoder = max(i for i, line in enumerate(plan) if "MapInArrow" in line)           # the branch of long texts comes last
    below = "\n".join(plan[encoder:])
    assert re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, row#\d+L, _n#\d+", below)


def test_encoding_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_digests(empty).count() == 0


def test_license_rules(spark):
    mit = licenses.KNOWN_TEXTS[0][1]
    rows = [(1, "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper()), (2, mit.replace("\n", " ")),
            (3, mit + " more"), (4, "Intro.\nLicenced under the MIT licence\nend\nReleased under the MIT License."), (5, None),
            (6, ""), (7, "Copyright 2020"), (7, "Copyright 2020"), (None, "licensed under CC BY 4.0"),
            (9, mit.replace("copyright holders", "copyright owners"))]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, license_id string")
    out = [(r.doc_id, r.license_id, r.line_licenses) for r in licenses.scan_licenses(docs).collect()]
    by = dict((i, (a, b)) for i, a, b in out)
    assert len(out) == len(rows)
    assert by[1][0] == by[2][0] == by[9][0] == "MIT" and by[3] == (None, None)
    assert by[4] == (None, "MIT") and by[5] == by[6] == by[7] == (None, None)
    assert by[None] == ("CC-BY-4.0", "CC-BY-4.0")
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def wrapped(text, widths):
    return {w: "\n".join(textwrap.fill(x, w) for x in text.split("\n")) for w in widths}


def canonicals(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.c for r in rows.select("i", licenses.canonical(F.col("text")).alias("c")).orderBy("i").collect()]


def test_only_notices_leave_a_license_text(spark):
    known = {i: t for i, t in licenses.KNOWN_TEXTS if i in ("MIT", "ISC") and len(t) > 100}
    rows = [(f"{i} {w}", i, "Copyright (c) 2020 Some One\n\n" + t) for i, text in known.items()
            for w, t in wrapped(" ".join(text.split()), range(20, 121)).items()]
    docs = spark.createDataFrame([(a, t) for a, _, t in rows], "doc_id string, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs).collect()}
    assert got == {a: i for a, i, _ in rows}
    body = ["(c) You must retain, in the Source form", "copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE",
            "Copyright Law of the land applies", "(c) Copyright notices stay", "(c) 20000 copies"]
    assert all(canonicals(spark, ["first\n" + x + "\nlast" for x in body])[k] != "first last" for k in range(len(body)))
    notices = ["Copyright 2020 A", "copyright (c) 1999-2004, B", "(C) 2011 C", "© 2020 D", "Copyright © E Inc.", "(c) Copyright 2001 F",
               "Copyright [yyyy] [name of copyright owner]", "Copyright <YEAR> <COPYRIGHT HOLDER>", "(c) {{ year }} {{ organization }}",
               "Copyright G, Inc. and others. All rights reserved.", "\tCopyright: 2020 H\nCopyright 2021 I"]
    assert set(canonicals(spark, ["first\n" + x + "\nlast" for x in notices])) == {"first last"}


def test_whole_licenses_with_and_without_title(spark):
    notice = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n"
    short = {"MIT": licenses.KNOWN_TEXTS[0][1], "ISC": licenses.KNOWN_TEXTS[1][1], "0BSD": licenses.KNOWN_TEXTS[2][1],
             "BSD-2-Clause": (license_texts.BSD_2 + license_texts.BSD_END).format(by="AUTHOR", of="AUTHOR"),
             "BSD-3-Clause": (license_texts.BSD_3 + license_texts.BSD_END).format(
                 holder="the copyright holder", its="its", by="COPYRIGHT HOLDERS AND CONTRIBUTORS", of="COPYRIGHT HOLDER OR CONTRIBUTORS"),
             "Zlib": license_texts.ZLIB}
    rows = [(i, x + t) for i, text in short.items() for t in wrapped(text, (40, 60, 72, 80, 100)).values()
            for x in ("", notice, *(f"{title}\n\n{notice}" for title in license_texts.TITLES[i]))]
    for i in license_texts.TITLE_LINES:
        title, text = license_texts.published(i)
        rows += [(i, text), (i, title + "\n" + text), (i, (title + "\n" + text).replace("https:", "http:"))]
        rows += [(i, f"{x}\n{t}") for t in wrapped(text, (80, 90, 100)).values() for x in ("", title)]
    assert len({i for i, _ in rows}) == len(license_texts.TITLES) == 15
    apache = "\n".join(license_texts.published("Apache-2.0"))
    rows += [("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2021 Some One")),
             ("Apache-2.0", apache.split(license_texts.TERMS)[0]), (None, apache.replace("perpetual", "passing"))]
    rows += [("Apache-2.0", t) for t in wrapped(apache, range(50, 121, 10)).values()]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs).collect()}
    assert [(i, t[:60]) for k, (i, t) in enumerate(rows) if got[k] != i] == []


def labelled(spark, folder, column):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = dict(duckdb.sql(f"select doc_id, {column} from '{folder}/labels.parquet'").fetchall())
    return docs, labels, truth


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark, SF, "quality")
    out = quality.quality_scores(docs, labels).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert len(out) == 1000 and len(held) > 50
    assert np.mean([a == b for a, b in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark, SF, "toxic")
    out = toxicity.toxicity_scores(docs, labels).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert len(out) == 1000 and np.mean([a == b for a, b in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_classifiers_do_not_learn_from_held_out_labels(spark):
    import zlib
    docs, labels, _ = labelled(spark, SMALL, "quality")
    flipped = labels.rdd.map(lambda r: (r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality)
                             ).toDF("doc_id long, quality int")
    a, b = (quality.quality_scores(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("score", [lambda d, x: quality.quality_scores(d, x), lambda d, x: toxicity.toxicity_scores(d, x)])
def test_classifiers_on_odd_tables(spark, score):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "plain words here"), (2, "BAD!! WORDS!!"), (4, None), (5, ""), (6, "  \n"), (7, "x" * 200_000), (1, "plain words here"),
            (None, "no id")]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, label int")
    out = score(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert score(docs, labels.limit(0)).count() == len(rows)
    assert score(docs.limit(0), labels).count() == 0


def test_features_of_junk_and_insults():
    good, bad = (quality.features(t) for t in ("Plain words in a line. More of them here.", "WORDS!! MORE!! | $$$ x%%% y***"))
    at = dict(zip(quality.FEATURES, zip(good, bad)))
    assert all(at[k][0] < at[k][1] for k in ("symbols", "exclaim", "capitals", "marked_words", "pipes"))
    w = toxicity._TokenWeights({"idiot": 3.0, "achli*": 2.0})
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are an Idiot, achlichung w0rd", w)))
    assert f["hits"] == pytest.approx(2 / 6) and f["near_you"] > 0 and f["obfuscated"] > 0 and f["top_weight"] == 3.0


def test_lexicon_places_go_to_distinct_words(spark):
    insults = [f"{a}{b}tten" for a in ("zu", "vo", "ki", "ra", "pe", "lo", "ga", "mi") for b in ("bra", "nel", "sof", "tup", "wik",
                                                                                         "dro", "fam", "hes", "jol", "que")]
    rows = [(f"plain text {w} here, {w}!", 1) for w in insults for _ in range(12)] + [("pathetic you", 1)] * 30
    rows += [(f"{w} talk", 1) for w in ("achlich", "achlicht", "achlung") for _ in range(12)] + [("the path here", 0)] * 5
    rows += [("plain text here you talk", 0)] * len(rows)
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(4))
    assert set(insults) <= set(lexicon)
    assert {"pathetic", "achlich", "achl*", "achli*"} <= set(lexicon) and not {"path*", "pathe*", "pathet*", "achlu*"} & set(lexicon)
    weights = toxicity._TokenWeights(lexicon)
    assert weights["path"] == 0 and weights["achlisch"] > 0 and weights["Pathetic!"] > 0


def test_pipeline_matches_plain_steps(spark, encoder):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, at = docs.columns, docs
    seen = {}
    for name, stage in cp.STAGES:
        at = cp.materialize(stage(spark, at, SMALL), "test_pipeline")
        if name != "bpe":
            assert at.columns == columns
        seen[name] = at.collect()
    toxic = {r.doc_id for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 1").collect()}
    clean = [r for r in docs.collect() if r.doc_id not in toxic]
    assert {r.doc_id for r in seen["toxicity"]} == {r.doc_id for r in clean}
    first = {}
    for r in sorted(clean, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in seen["exact_dedup"]) == sorted(first.values())
    from tests.llm.test_near import truth
    exact = sorted((r.doc_id, r.text) for r in seen["exact_dedup"])
    assert sorted(r.doc_id for r in seen["near_dedup"]) == sorted(i for i, (_, c) in truth(exact).items() if i == c)
    words = {}
    for r in seen["near_dedup"]:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    taken = {}
    for r in seen["mixing"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    from tests.llm.test_rows import fill
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(words))}
    for s, t in fill(words, weights, 1.5 * sum(words.values())).items():
        assert abs(taken.get(s, 0) - t) <= 0.05 * t + 60
    text = {r.doc_id: r.text for r in seen["near_dedup"]}
    assert sorted((r.doc_id, r.ids_sha256) for r in seen["bpe"]) == sorted(
        (r.doc_id, hashlib.sha256(" ".join(map(str, encoder.encode_ordinary(text[r.doc_id]))).encode()).hexdigest())
        for r in seen["mixing"])


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as cp
    at = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        at = stage(spark, at, SMALL)
        assert at.count() == 0


def test_pipeline_keeps_columns_and_defined_rows(spark, tmp_path):
    """Extra columns with the names that operators use; null ids and texts, repeats, a long text."""
    import corpus_pipeline as cp
    extra = ["copies", "_id", "_th", "_h", "_n", "_nth", "slot", "key", "doc", "order", "kept", "text_hash", "row"]
    words = [f"word{i}" for i in range(400)]
    texts = [(1, " ".join(words[:50]), "a"), (2, " ".join(words[:50]), "a"), (3, " ".join(words[50:150]), "b"),
             (4, " ".join(words[50:150]) + " more", "b"), (None, " ".join(words[150:200]), "b"), (None, " ".join(words[150:200]), "b"),
             (5, None, "a"), (6, "", None), (7, " ".join(words * 200), None), (8, " ".join(words[200:300]), None),
             (8, " ".join(words[200:300]), None), (9, "one two three", "a")]
    rows = [(i, t, s, *[k * 100 + n for n in range(len(extra))]) for k, (i, t, s) in enumerate(texts)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in extra)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    whole = {r[3:]: r for r in rows}
    at = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs if not at else at["docs"], str(tmp_path))
        assert out.columns == docs.columns
        at = {"docs": cp.materialize(out, "test_stage")}
        kept = [tuple(r) for r in at["docs"].collect()]
        assert all(whole[r[3:]] == r for r in kept)                     # no value was touched
        if name == "toxicity":
            assert sorted(kept, key=str) == sorted(rows, key=str)
        if name == "exact_dedup":
            assert sorted((r[0] or 0) for r in kept) == [0, 1, 3, 4, 5, 7, 8, 9]
        if name == "near_dedup":
            assert sorted((r[0] or 0) for r in kept) == [0, 1, 3, 5, 7, 8, 9]
        if name == "mixing":
            assert {r[0] for r in kept} <= {None, 1, 3, 7, 8, 9}
    again = cp.staying(docs, spark.createDataFrame([(8, True), (8, False), (9, False)], "doc_id long, kept boolean").join(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash")).distinct(), "doc_id")).collect()
    assert Counter(r.doc_id for r in again) == Counter([1, 2, 3, 4, None, None, 5, 6, 7, 8])
    assert at["docs"].count() and cp.STAGES[-1][1](spark, at["docs"], str(tmp_path)).count() == at["docs"].count()
