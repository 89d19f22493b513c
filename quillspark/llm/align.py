"""Alignment of two tokenizers: byte intervals of both, coalesced into groups."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import tiktoken
import tokenizers
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import text_or_empty
from quillspark.session import ship_package
from quillspark.sinks.snapshots import materialize

SLICE_BYTES = 200_000       # text that is tokenised at once
BLOCK_LINKS = 2_000_000     # links whose id pairs are counted in the task before they are shuffled
PIECE = 65_536              # id pairs in one stored row
LONG = 100_000              # characters from which a text goes to the model whole

# Fixed value: where the byte-level model cuts a text before its merges.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters outside of these may be classed differently by two Unicode versions.
UNSETTLED = regex.compile("[^\x20-\x7e\t\n\u00a0-\u024f\u0410-\u044f\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")

_LOADED: dict[int, "Pair"] = {}


def default_models() -> tuple[str, str]:
    """Paths of the byte-level model (A) and of the piece model (B)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable
    Latin-1 characters stand for themselves, the other bytes, in order, follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_ranks(model: bytes) -> dict[bytes, int]:
    """Bytes of the tokens of a byte-level model -> ids, without added tokens."""
    alphabet, content = byte_alphabet(), json.loads(model)
    added = {t["id"] for t in content["added_tokens"]}
    return {bytes(alphabet[c] for c in t): i for t, i in content["model"]["vocab"].items() if i not in added}


def merges_by_rank(model: bytes) -> bool:
    """Whether merging the neighbours that make the token of least id gives what the
    model's list of merges gives. It does if ids follow the order of the list and if
    each token, merged alone from tokens of smaller id, comes from its listed halves:
    inside a pre-token, the bytes that end as two halves never met those around them."""
    content = json.loads(model)
    cut, ranks, alphabet = content["pre_tokenizer"], byte_ranks(model), byte_alphabet()
    if content["normalizer"] or cut["type"] != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"]:
        return False
    last = 255
    for merge in content["model"]["merges"]:
        halves = [bytes(alphabet[c] for c in half) for half in (merge.split(" ") if isinstance(merge, str) else merge)]
        token = b"".join(halves)
        last += 1
        if ranks.get(token) != last:
            return False
        parts = [token[i: i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], last), i) for i in range(len(parts) - 1))
            if rank >= last:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        if parts != halves:
            return False
    return len(ranks) == last + 1


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes, by_rank: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"         # Spark has a task on every core
        self.a = tokenizers.Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.ranks = tiktoken.Encoding("a", pat_str=PRE_TOKENS, special_tokens={}, mergeable_ranks=byte_ranks(a)) if by_rank else None
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # Decimal ids with what may follow them: next of the group, other side, next group, end.
        self.words = [str(i) + mark for mark in (",", "|", ";", "") for n in (len(self.a_bytes), len(self.b_bytes)) for i in range(n)]
        self.n_words = len(self.a_bytes) + len(self.b_bytes)

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of A, by ranks where these give the same: see ``merges_by_rank``."""
        whole = [t for t in texts if not self.ranks or len(t) >= LONG or UNSETTLED.search(t)]
        ids = iter([e.ids for e in self.a.encode_batch_fast(whole, add_special_tokens=False)] if whole else [])
        return [next(ids) if not self.ranks or len(t) >= LONG or UNSETTLED.search(t) else self.ranks.encode_ordinary(t) for t in texts]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text; none where either does not give the text back."""
        a = self.encode_a([" " + t for t in texts])
        b = self.b.encode(texts, num_threads=1)
        for i, t in enumerate(texts):
            raw = b" " + t.encode()
            if not t or b"".join(map(self.a_bytes.__getitem__, a[i])) != raw or b"".join(map(self.b_bytes.__getitem__, b[i])) != raw:
                a[i], b[i] = [], []
        return a, b


def _load(shared: Broadcast) -> Pair:
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED[key] = Pair(*shared.value)
    return _LOADED[key]


def coalesce(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all intervals by start (A before B) and which of them begin a group:
    those whose start reaches the largest end before them."""
    order = np.lexsort((kind, start))
    begins = np.ones(len(order), bool)
    if len(order):
        begins[1:] = start[order][1:] >= np.maximum.accumulate(end[order])[:-1]
    return order, begins


def overlaps(order: np.ndarray, begins: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping (A, B) interval pairs inside the groups, in order: every
    interval but a group's first meets the last one of the other side."""
    place = np.arange(len(order))
    is_b = kind[order] == 1
    last_a = np.maximum.accumulate(np.where(is_b, 0, place))
    last_b = np.maximum.accumulate(np.where(is_b, place, 0))
    return order[last_a[~begins]], order[last_b[~begins]]


class Aligned:
    """Alignment of a few texts: flat arrays over the tokens of all, A first.

    ``group`` numbers the groups over all texts; ``pair_a`` and ``pair_b`` are the
    overlapping tokens, ``linked`` marks those that end together."""

    def __init__(self, pair: Pair, a: list[list[int]], b: list[list[int]]):
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.ids = np.fromiter(chain.from_iterable(chain(a, b)), np.int64, int(self.n_a.sum() + self.n_b.sum()))
        total = int(self.n_a.sum())
        self.kind = (np.arange(len(self.ids)) >= total).astype(np.int64)
        texts = np.arange(len(a))
        self.text = np.concatenate([np.repeat(texts, self.n_a), np.repeat(texts, self.n_b)])
        self.end = np.concatenate([np.cumsum(pair.a_size[self.ids[:total]]), np.cumsum(pair.b_size[self.ids[total:]])]).astype(np.int64)
        self.start = self.end - np.concatenate([pair.a_size[self.ids[:total]], pair.b_size[self.ids[total:]]])
        order, begins = coalesce(self.start, self.end, self.kind)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(begins) - 1
        self.n_groups = np.bincount(self.text[order][begins], minlength=len(a))
        self.pair_a, self.pair_b = overlaps(order, begins, self.kind)
        self.linked = self.end[self.pair_a] == self.end[self.pair_b]

    def written(self, pair: Pair) -> list[str]:
        """``a1,a2|b1;a3|b2`` of every text."""
        order = np.argsort(2 * self.group + self.kind, kind="stable")
        group, kind, text = self.group[order], self.kind[order], self.text[order]
        mark = np.full(len(order), 3)
        if len(order):
            mark[:-1] = np.where(text[1:] != text[:-1], 3, np.where(group[1:] != group[:-1], 2, (kind[1:] != kind[:-1]).astype(int)))
        words = [pair.words[i] for i in (mark * pair.n_words + kind * len(pair.a_bytes) + self.ids[order]).tolist()]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(words[s:e]) for s, e in zip([0, *ends], ends)]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """First rows and texts of runs of about ``limit`` bytes, one text at least."""
    start, size, sizes = 0, 0, pc.binary_length(texts).to_pylist()
    for i, n in enumerate(sizes):
        size += n
        if size >= limit or i == len(sizes) - 1:
            yield start, texts.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int64)
    offsets[1:] = np.cumsum(sizes)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


GROUP = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, groups (array of start, end, a, b).

    Space + text by the byte-level model (A) and the text by the piece model (B,
    which puts the space itself), both without special tokens. The byte ranges of
    all tokens are sorted by start; a group ends where a start reaches the
    largest end so far, so groups are the least ranges that both tokenizers cut
    out alike; ``start`` and ``end`` are byte offsets in space + text.
    Texts that are null, empty, or not given back byte by byte by both have no
    groups. Repeated rows and ids are aligned each on its own; an empty table
    gives an empty result. A text is tokenised whole in one task.
    """
    shared = _share(docs, models)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _load(shared)
        for batch in batches:
            for first, texts in slices(batch.column("_text")):
                al = Aligned(pair, *pair.encode(texts))
                order = np.argsort(2 * al.group + al.kind, kind="stable")
                n = int(al.n_groups.sum())
                kind, group, ids = al.kind[order], al.group[order], al.ids[order]
                low, high = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
                np.minimum.at(low, al.group, al.start)
                np.maximum.at(high, al.group, al.end)
                ends = np.cumsum(al.n_groups)
                base = np.where(ends > al.n_groups, low[np.minimum(ends - al.n_groups, max(n - 1, 0))], 0) if n else np.zeros(len(ends), np.int64)
                shift = np.repeat(base, al.n_groups)
                sides = [_lists(ids[kind == k], np.bincount(group[kind == k], minlength=n), pa.int32()) for k in (0, 1)]
                flat = pa.StructArray.from_arrays([pa.array(low - shift), pa.array(high - shift), *sides], fields=list(GROUP))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.ListArray.from_arrays(offsets, flat)],
                                                 names=["doc_id", "groups"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


def _share(docs: DataFrame, models: tuple[str, str] | None) -> Broadcast:
    ship_package(docs.sparkSession)
    raw = []
    for path in models or default_models():
        with open(path, "rb") as f:
            raw.append(f.read())
    return docs.sparkSession.sparkContext.broadcast((*raw, merges_by_rank(raw[0])))        # two vocabulary files


DOC = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
       "codes array<int>, uses array<int>, base int, a array<int>, b array<int>, n array<long>")


class _Block:
    """Documents of a task whose id pairs are numbered together."""

    def __init__(self, number: int):
        self.number, self.docs, self.keys, self.owner = number, [], [], []
        self.links = 0

    def add(self, doc_id: list, al: Aligned, written: list[str], n_ids: int) -> None:
        a, b = al.pair_a[al.linked], al.pair_b[al.linked]
        self.keys.append(al.ids[a] * n_ids + al.ids[b])
        self.owner.append(al.text[a] + len(self.docs))
        links = np.bincount(al.text[a], minlength=len(doc_id))
        for row in zip(doc_id, al.n_a.tolist(), al.n_b.tolist(), al.n_groups.tolist(), links.tolist(), written):
            self.docs.append((*row[:5], hashlib.sha256(row[5].encode()).hexdigest() if row[1] else ""))
        self.links += len(a)

    def batches(self, n_ids: int) -> Iterator[pa.RecordBatch]:
        """The documents with their numbered pairs, then the pairs in pieces."""
        names, code, uses = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        mine, held = np.unique(np.concatenate(self.owner) * max(len(names), 1) + code, return_counts=True)
        sizes = np.bincount(mine // max(len(names), 1), minlength=len(self.docs))
        schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                            ("groups_sha256", pa.string()), ("codes", pa.list_(pa.int32())), ("uses", pa.list_(pa.int32())),
                            ("base", pa.int32()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

        def batch(rows: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) if f.name != "block"
                                               else pa.array([self.number] * rows, f.type) for f in schema], schema=schema)

        ends = np.concatenate([[0], np.cumsum(sizes)])
        for s in range(0, len(self.docs), 5000):
            part, cut = self.docs[s: s + 5000], slice(ends[s], ends[min(s + 5000, len(self.docs))])
            columns = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links"), (pa.array(c, pa.int64()) for c in zip(*(r[:5] for r in part)))))
            yield batch(len(part), **columns, groups_sha256=pa.array([r[5] for r in part]),
                        codes=_lists(mine[cut] % max(len(names), 1), sizes[s: s + 5000], pa.int32()),
                        uses=_lists(held[cut], sizes[s: s + 5000], pa.int32()))
        for s in range(0, len(names), PIECE):
            part = names[s: s + PIECE]
            one = np.array([len(part)])
            yield batch(1, base=pa.array([s], pa.int32()), a=_lists(part // n_ids, one, pa.int32()),
                        b=_lists(part % n_ids, one, pa.int32()), n=_lists(uses[s: s + PIECE], one, pa.int64()))


def _blocks(shared: Broadcast, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first = _load(shared), TaskContext.get().partitionId() << 32
        n_ids = len(pair.b_bytes)
        block = _Block(first)
        for batch in batches:
            for start, texts in slices(batch.column("_text")):
                al = Aligned(pair, *pair.encode(texts))
                block.add(batch.column("doc_id").slice(start, len(texts)).to_pylist(), al, al.written(pair), n_ids)
                if block.links >= limit:
                    yield from block.batches(n_ids)
                    block = _Block(block.number + 1)
        if block.docs:
            yield from block.batches(n_ids)
    return run


def _grade(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of the documents of a block from its pairs' corpus counts."""
    code = pairs.column("code").to_numpy()
    links, top = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    links[code], top[code] = pairs.column("links").to_numpy(), pairs.column("top").to_numpy()
    lists, uses = docs.column("codes").combine_chunks(), docs.column("uses").combine_chunks().flatten().to_numpy()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))

    def summed(values: np.ndarray) -> pa.Array:
        total = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])]
        return pa.array(np.diff(total), pa.int64())

    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", summed(uses * top[flat])).append_column("count_sum", summed(uses * links[flat]))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


GRADED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: tuple[str, str] | None = None,
                     block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Groups as in ``align``. Links are the overlapping A-B pairs that end together.
    An id pair counts its links in all documents; ``n_best`` counts the links
    whose pair has the highest count of its B id (ties included), ``count_sum``
    adds up the counts over the links.

    Tokenising happens once. A task numbers the pairs of about ``block_links``
    links at a time and stores documents and numbered pairs as one block, so a
    frequent pair gives one row per block, not one per document. Counts are
    summed per pair, and each block gets those of its own pairs back.

    Texts without tokens (see ``align``) have zeros and an empty digest. Null ids
    stay null; repeated rows and ids are counted each; an empty table gives an
    empty result; other columns are not read.
    """
    shared = _share(docs, models)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text"))
    stored = materialize(rows.mapInArrow(_blocks(shared, block_links), DOC), "align_blocks")
    pairs = (stored.where("base is not null")
             .select("block", "base", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p"))
             .select("block", (F.col("base") + F.col("at")).alias("code"), "p.a", "p.b", "p.n"))
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("links")), "align_counts")
    highest = counts.groupBy("b").agg(F.max("links").alias("most"))
    graded = counts.join(highest, "b").select("a", "b", "links", (F.col("links") == F.col("most")).cast("long").alias("top"))
    back = pairs.select("block", "code", "a", "b").join(graded, ["a", "b"]).select(F.col("block").alias("of_block"), "code", "links", "top")
    of_docs = stored.where("base is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "uses")
    return of_docs.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_grade, GRADED)
