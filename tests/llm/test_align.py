"""Alignment of tokenizers against plain loops."""

import hashlib
import json
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import align


def models():
    out = []
    for path in align.default_models():
        with open(path, "rb") as f:
            out.append(f.read())
    return align.Pair(*out, align.merges_by_rank(out[0]))


PAIR = models()
TEXTS = [None, "", " ", "Hello, world", "naïve café 漢字 🐱", "  two  spaces\n\n tabs\t", "<|endoftext|> and </s> <unk>", "ﬁ ligature",
         "a" * 3000, "the thing that the thing knew " * 400, "\x00\x01 \u2581 x", "123456789 \r\n 0.5", "Hello, world", "é" * 500, "\u2581"]


def tokens(text):
    """Byte tokens of both, each looked up on its own; none where they differ from the text."""
    if not text:
        return [], []
    a = PAIR.a.encode(" " + text, add_special_tokens=False)
    b = PAIR.b.encode(text)
    alphabet = align.byte_alphabet()
    ta = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
    tb = [(i, bytes([int(p[3:5], 16)]) if PAIR.b.is_byte(i) else p.replace("\u2581", " ").encode())
          for i, p in ((i, PAIR.b.id_to_piece(i)) for i in b)]
    raw = (" " + text).encode()
    if b"".join(t for _, t in ta) != raw or b"".join(t for _, t in tb) != raw:
        return [], []
    return ta, tb


def groups(text):
    """(ids of A, ids of B) between the offsets where both end a token."""
    ta, tb = tokens(text)
    ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (ta, tb)]
    shared = sorted(set(ends[0]) & set(ends[1]))
    out, done = [], 0
    for e in shared:
        out.append(tuple([i for (i, _), x in zip(side, at) if done < x <= e] for side, at in zip((ta, tb), ends)))
        done = e
    links = [(i, j) for (i, _), x in zip(ta, ends[0]) for (j, _), y in zip(tb, ends[1]) if x == y]
    return out, links, ends


def want(texts):
    per = [groups(t) for t in texts]
    counts = Counter(p for _, links, _ in per for p in links)
    top = {}
    for (_, b), c in counts.items():
        top[b] = max(top.get(b, 0), c)
    out = []
    for gs, links, _ in per:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links),
                    sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return out


def test_ranks_give_the_ids_of_the_model():
    with open(align.default_models()[0], "rb") as f:
        raw = f.read()
    assert align.merges_by_rank(raw)
    swapped = json.loads(raw)
    swapped["model"]["merges"][:2] = swapped["model"]["merges"][1::-1]
    assert not align.merges_by_rank(json.dumps(swapped).encode())
    rng = np.random.default_rng(1)
    tokens = [t.replace("\u0120", " ") for t in sorted(PAIR.a.get_vocab()) if t.replace("\u0120", " ").isascii()]
    texts = [" " + "".join(rng.choice(tokens, 60)) for _ in range(3000)] + [" " + t for t in TEXTS if t]
    assert PAIR.encode_a(texts) == [e.ids for e in PAIR.a.encode_batch(texts, add_special_tokens=False)]


DOCS = "doc_id long, text string, block long, a int, codes string, n int"


def test_counts_match_plain_loops(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in enumerate(TEXTS)], DOCS).repartition(3)
    for limit in (1, 50, align.BLOCK_LINKS):          # blocks of a text each, of some texts, of a task
        out = sorted(map(tuple, align.alignment_counts(docs, block_links=limit).collect()))
        assert out == [(i, *row) for i, row in enumerate(want(TEXTS))]


def test_null_repeated_and_empty(spark):
    rows = [(None, "Hello, world", 1, 2, "x", 3), (None, None, 1, 2, "x", 3), (4, "Hello there", 1, 2, "x", 3), (4, "Hello there", 1, 2, "x", 3)]
    out = align.alignment_counts(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(tuple(r)[1:] for r in out) == Counter(want([r[1] for r in rows]))
    assert align.alignment_counts(spark.createDataFrame([], DOCS)).count() == 0
    assert align.align(spark.createDataFrame([], DOCS)).count() == 0


def test_groups_carry_byte_ranges(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in enumerate(TEXTS)], DOCS).repartition(2)
    for r in align.align(docs).collect():
        gs, _, ends = groups(TEXTS[r.doc_id])
        assert [(g.a, g.b) for g in r.groups] == gs
        cuts = [0, *sorted(set(ends[0]) & set(ends[1]))]
        assert [(g.start, g.end) for g in r.groups] == list(zip(cuts, cuts[1:]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12))
def test_overlaps_match_all_pairs(a, b):
    short = abs(sum(a) - sum(b))                      # both cover the same range
    (a if sum(a) < sum(b) else b).extend([short] if short else [])
    size = np.array(a + b)
    kind = np.array([0] * len(a) + [1] * len(b))
    end = np.concatenate([np.cumsum(a), np.cumsum(b)])
    start = end - size
    order, begins = align.coalesce(start, end, kind)
    pa, pb = align.overlaps(order, begins, kind)
    got = sorted(zip(pa.tolist(), pb.tolist()))
    assert got == [(i, j) for i in range(len(a)) for j in range(len(a), len(size)) if start[i] < end[j] and start[j] < end[i]]
    assert begins.sum() == len(set(np.cumsum(a)) & set(np.cumsum(b)))
