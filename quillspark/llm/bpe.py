"""Byte-level BPE: overlapping chunks, stitched where pre-token boundaries meet."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, text_or_empty
from quillspark.session import ship_package
from quillspark.sinks.snapshots import materialize

CHUNK = 32768       # characters between chunk starts
OVERLAP = 1024      # characters that a chunk shares with the next one
MARGIN = 3          # a pre-token this far from the chunk's end can't change any more
GROUP_IDS = 400_000      # ids that a task holds as Python numbers before they become a batch

_LOADED: dict[tuple, object] = {}


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pre-token pattern."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) }


def _once(kind: str, shared: Broadcast, make):
    """Built once in a Python worker and vocabulary."""
    key = (kind, hash(shared.value))
    if key not in _LOADED:
        _LOADED[key] = make(*shared.value)
    return _LOADED[key]


def _encoder(shared: Broadcast) -> tiktoken.Encoding:
    return _once("encoder", shared, lambda raw, pattern: tiktoken.Encoding(
        "ranks", pat_str=pattern, mergeable_ranks=load_ranks(raw), special_tokens={}))


def _token_bytes(shared: Broadcast) -> list[bytes]:
    def make(raw: bytes, pattern: str) -> list[bytes]:
        ranks = load_ranks(raw)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        return table
    return _once("bytes", shared, make)


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of the pre-tokens of a chunk, and its end."""
    return [m.start() for m in regex.finditer(pattern, text)] + [len(text)]


def chunk_ends(text: str, pattern: str, start: int, step: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries, as positions in the whole text, in the chunk's first
    ``overlap`` characters and in those it shares with the next chunk. Near the
    chunk's end a boundary may still move, so the last ones are left out. Those
    behind white space are left out too: how a run of it is cut depends on what
    follows, and a piece must give the same pre-tokens alone as in the text."""
    at = [p for p in boundaries(text, pattern) if p and not text[p - 1].isspace()]
    head = [start + p for p in at if p < overlap]
    tail = [start + p for p in at if step <= p <= len(text) - MARGIN]
    return head, tail


def _encode_batches(shared: Broadcast, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts, start, ids, size = batch.column("_text"), 0, [], 0
            for i in range(batch.num_rows):
                one = encoder.encode_ordinary(texts[i].as_py())
                ids.append(one)
                size += len(one)
                if size >= GROUP_IDS or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in carry] + [pa.array(ids, pa.list_(pa.int32()))],
                                                     names=[*carry, "ids"])
                    start, ids, size = i + 1, [], 0
    return run


def _mark_batches(shared: Broadcast, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = shared.value[1]
        for batch in batches:
            ends = [chunk_ends(t, pattern, n * chunk, (to + 1 - n) * chunk, overlap)
                    for t, n, to in zip(*(batch.column(c).to_pylist() for c in ("_text", "_n", "_to")))]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "_n", "_to", "_len")]
                                             + [pa.array([e[0] for e in ends], kind), pa.array([e[1] for e in ends], kind)],
                                             names=["row", "_n", "_to", "_len", "_head", "_tail"])
    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, row, ids (array of int).

    A text longer than ``chunk`` + ``overlap`` characters becomes overlapping
    chunks that any task may pre-tokenise; they are stored once, and only their
    boundaries come together by document. Two neighbours are stitched at the
    first place in their overlap where both have a pre-token boundary: matching
    goes on from a boundary without memory, so from there on they agree. The
    pieces between stitches hold whole pre-tokens; they are dealt out by document
    and piece, encoded apart, then joined in order. Neighbours that never meet
    (one pre-token longer than the overlap) are put together and marked again
    from their common start, until all meet; the other chunks of the text stay
    apart. Shorter texts are one chunk. Null counts as empty, an empty text has no
    ids. Repeated rows and ids stay apart by ``row``.
    """
    shared = _share(docs, vocabulary)
    short, whole = _split(docs, id_col, text_col, shared, chunk, overlap)
    kind = short.schema["doc_id"].dataType.simpleString()
    return short.mapInArrow(_encode_batches(shared, ["doc_id", "row"]), f"doc_id {kind}, row long, ids array<int>").unionByName(whole)


def _share(docs: DataFrame, vocabulary: tuple[str, str] | None) -> Broadcast:
    path, pattern = vocabulary or default_vocabulary()
    ship_package(docs.sparkSession)
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((f.read(), pattern))       # one vocabulary file


def _split(docs: DataFrame, id_col: str, text_col: str, shared: Broadcast, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk (doc_id, row, _text), and the ids of longer ones (doc_id, row, ids)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       text_or_empty(text_col).alias("_text")).withColumn("_len", F.char_length("_text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    short = rows.where(F.col("_len") <= chunk + overlap).select("doc_id", "row", "_text")

    long = rows.where(F.col("_len") > chunk + overlap)
    last = F.ceil((F.col("_len") - overlap) / chunk).cast("int") - 1
    chunks = (long.withColumn("_n", F.explode(F.sequence(F.lit(0), last)))
              .select("doc_id", "row", "_n", "_len", (F.col("_n") * chunk).alias("_start"),
                      F.substring("_text", F.col("_n") * chunk + 1, F.lit(chunk + overlap)).alias("_chunk"))
              .repartition(partitions(spark), "row", "_n"))
    chunks = materialize(chunks, "bpe_chunks")
    joined = _texts(chunks, _pieces(chunks, shared, chunk, overlap), chunk)         # any task may encode a piece
    parts = joined.mapInArrow(_encode_batches(shared, ["doc_id", "row", "_n"]), f"doc_id {id_type}, row long, _n int, ids array<int>")
    whole = (parts.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("_n", "ids"))).alias("_p"))
             .select("doc_id", "row", F.flatten(F.col("_p.ids")).alias("ids")))
    return short, whole


def _texts(chunks: DataFrame, spans: DataFrame, chunk: int) -> DataFrame:
    """The texts from ``_begin`` to ``_end`` of runs of chunks ``_n`` to ``_to``, dealt out by document and run."""
    of_chunk = spans.select("row", F.explode(F.sequence("_n", "_to")).alias("_m"), "_n", "_to", "_begin", "_end")
    parts = chunks.withColumnRenamed("_n", "_m").join(of_chunk, ["row", "_m"])
    begin = F.greatest(F.col("_begin"), F.col("_start")) - F.col("_start")
    end = F.when(F.col("_m") == F.col("_to"), F.col("_end") - F.col("_start")).otherwise(chunk)
    return (parts.select("doc_id", "row", "_n", "_to", "_len", "_m", _slice("_chunk", begin, end).alias("_text"))
            .groupBy("doc_id", "row", "_n", "_to", "_len").agg(F.array_sort(F.collect_list(F.struct("_m", "_text"))).alias("_p"))
            .select("doc_id", "row", "_n", "_to", "_len", F.array_join(F.col("_p._text"), "").alias("_text")))


def _pieces(chunks: DataFrame, shared: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """row, _n, _to, _begin, _end: the pieces between stitches, with their first and
    last chunk. Boundaries come together by document, texts don't.

    A boundary of a chunk is sure only from where it meets its neighbour on the
    left, so runs of neighbours that miss are marked again as one text before
    their right end may be stitched."""
    marks = "row long, _n int, _to int, _len int, _head array<int>, _tail array<int>"

    def mark(texts: DataFrame) -> DataFrame:
        return texts.select("row", "_n", "_to", "_len", "_text").mapInArrow(_mark_batches(shared, chunk, overlap), marks)
    marked = materialize(mark(chunks.withColumns({"_to": F.col("_n"), "_text": F.col("_chunk")})), "bpe_marks")
    in_order = Window.partitionBy("row").orderBy("_n")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    while True:
        meet = F.array_min(F.array_intersect("_tail", F.lead("_head").over(in_order)))
        seams = marked.withColumn("_seam", F.when(F.lead("_n").over(in_order).isNull(), F.col("_len")).otherwise(meet))
        if seams.where(F.col("_seam").isNull()).isEmpty():
            return seams.select("row", "_n", "_to", F.coalesce(F.lag("_seam").over(in_order), F.lit(0)).alias("_begin"),
                                F.col("_seam").alias("_end"))
        numbered = seams.withColumn("_run", F.count("_seam").over(before)).drop("_seam")
        runs = (numbered.groupBy("row", "_run").agg(F.min("_n").alias("_n"), F.max("_to").alias("_to"), F.count("*").alias("_many"))
                .withColumns({"_begin": F.col("_n") * chunk, "_end": (F.col("_to") + 1) * chunk + overlap}))
        kept = numbered.join(runs.where("_many = 1").select("row", "_run"), ["row", "_run"], "left_semi").drop("_run")
        marked = materialize(kept.unionByName(mark(_texts(chunks, runs.where("_many > 1"), chunk))), "bpe_marks")


def _slice(col: str, start: Column, end: Column) -> Column:
    return F.substring(F.col(col), start + 1, end - start)


def _decode_batches(shared: Broadcast, carry: list[str], ids_col: str = "ids", rows: int = 200):
    """Batches with ids -> batches of a few rows with their raw bytes besides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(shared)
        for batch in batches:
            column = batch.column(ids_col)
            for start in range(0, batch.num_rows, rows):
                part = column.slice(start, rows)
                flat, ends, null = part.values.to_numpy(), part.offsets.to_numpy(), part.is_null().to_pylist()
                out = [None if null[i] else b"".join([table[k] for k in flat[ends[i]: ends[i + 1]].tolist()])
                       for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, rows) for c in carry] + [pa.array(out, pa.binary())],
                                                 names=[*carry, "decoded"])
    return run


def decode(rows: DataFrame, ids_col: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``rows`` with ``ids_col`` replaced by ``decoded``: the raw bytes of its ids
    in a row (binary, as ids may end inside a character). Null ids give null."""
    carry = [c for c in rows.columns if c != ids_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != ids_col)
    return rows.mapInArrow(_decode_batches(_share(rows, vocabulary), carry, ids_col), f"{schema}, decoded binary")


def _digest_batches(shared: Broadcast):
    """Batches of doc_id and ids -> lengths and digests of the ids and of what they decode to."""
    decoded = _decode_batches(shared, ["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoded(batches):
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids]),
                 pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in batch.column("decoded")])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   vocabulary: tuple[str, str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, there and back.

    The steps of ``encode`` and ``decode``, one behind the other in the same task,
    so that the ids themselves never leave it."""
    shared = _share(docs, vocabulary)
    short, whole = _split(docs, id_col, text_col, shared, chunk, overlap)
    encoded, digest = _encode_batches(shared, ["doc_id"]), _digest_batches(shared)
    kind = short.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return short.mapInArrow(lambda batches: digest(encoded(batches)), out).unionByName(
        whole.select("doc_id", "ids").mapInArrow(digest, out))
