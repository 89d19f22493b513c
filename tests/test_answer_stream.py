"""T1 / T2 as one step for all requests of a micro-batch."""

import random

import pandas as pd
import pytest

from quillspark.session import shared_path
from quillspark.sources import fixtures as fx
from quillspark.streaming import chunks as CH


class _State:
    """What the step of one request sees of its state."""
    value, hasTimedOut, exists = None, False, False

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value, self.exists = v, True

    def setTimeoutDuration(self, ms):
        pass


def _random_answer(rng):
    pieces = ["a", "é", "貓", "😀", "\n", "\x85", b"\xff", b"\xe0\x80", b"\xed\xa0\x80", b"\xf4\x90", b"\xf0\x9f", b"\xc3", b"\xe8\xb2", b"\xc0"]
    return b"".join(p.encode() if isinstance(p, str) else p for p in rng.choices(pieces, k=rng.randint(0, 14)))


def _deliver(spark, writer, rows, batch_id):
    writer(spark.createDataFrame(rows, CH.CHUNK_SCHEMA), batch_id)


@pytest.fixture()
def stream(spark):
    now = [1_000.0]
    table, updates = CH.answer_table(spark, shared_path(spark, "test", "answers"), 4), shared_path(spark, "test", "updates")
    log = shared_path(spark, "test", "log")
    writer = CH.assemble_batch_writer(table, updates, lambda b: CH.save_finished(spark, updates, log, b), lambda: now[0], 2)
    return table, updates, log, writer, now


def test_one_step_equals_the_step_of_each_request(spark, stream):
    table, updates, log, writer, _ = stream
    rng, batches, answers = random.Random(3), 5, {}
    sent = [[] for _ in range(batches)]
    for request in range(120):
        b = _random_answer(rng)
        size = rng.randint(1, 5)
        cut = [b[i:i + size] for i in range(0, len(b), size)] or [b""]
        answers[request] = b
        for no, chunk in enumerate(cut):
            row = (request, no, chunk, no == len(cut) - 1)
            for at in rng.choices(range(batches), k=rng.choice([1, 1, 1, 2])):       # any order, some delivered twice
                sent[at].append(row)
    states, want, first = {}, [], {}
    for at, rows in enumerate(sent):
        rng.shuffle(rows)
        for request in sorted({r[0] for r in rows}):
            first.setdefault(request, at)
            pdf = pd.DataFrame([r[1:] for r in rows if r[0] == request], columns=["chunk_no", "chunk", "is_last"])
            for out in CH._assemble((request,), iter([pdf]), states.setdefault(request, _State())):
                u = out.to_dict("records")[0]
                want.append((at, request, first[request], u["n_chunks"], u["added"], u["done"]))
        _deliver(spark, writer, rows, at)
    got = CH.update_log(spark, updates).select("batch", "request_id", "first_batch", "n_chunks", "added", "done").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    saved = {r.request_id: r.content for r in spark.read.parquet(log).collect()}
    assert saved == {k: b.decode("utf-8", "replace") for k, b in answers.items()}
    assert CH.newest(table.rows(), table.deltas(), 0).where("kept_until is null or size(early) > 0").count() == 0


def test_the_step_calls_no_python_per_request(spark):
    chunks = spark.createDataFrame([(1, 0, b"a", True)], CH.CHUNK_SCHEMA)
    plan = CH.assemble_step(chunks, spark.createDataFrame([], CH.STATE_SCHEMA), 0, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_replays_marks_and_folds(spark, stream):
    table, updates, log, writer, now = stream
    _deliver(spark, writer, [(1, 0, b"ab", False), (1, 2, b"e", True), (2, 0, b"x", True), (None, 0, b"n", True)], 0)
    before = set(map(tuple, CH.update_log(spark, updates).collect()))
    _deliver(spark, writer, [(1, 0, b"ab", False), (1, 2, b"e", True), (2, 0, b"x", True), (None, 0, b"n", True)], 0)
    assert set(map(tuple, CH.update_log(spark, updates).collect())) == before and table.manifest().version == 0
    assert {r.request_id: r.content for r in spark.read.parquet(log).collect()} == {2: "x", None: "n"}
    _deliver(spark, writer, [(1, 1, b"cd", False), (2, 0, b"x", True)], 1)           # 2 is finished: no update
    assert [(r.request_id, r.added, r.done) for r in CH.update_log(spark, updates).where("batch = 1").collect()] == [(1, "cde", True)]
    assert {r.request_id: r.content for r in spark.read.parquet(log).where("batch = 1").collect()} == {1: "abcde"}
    now[0] += CH.FINISHED_MS / 1000 + 1                                              # the marks are gone: 2 begins anew
    _deliver(spark, writer, [(2, 0, b"y", False)], 2)
    _deliver(spark, writer, [(2, 1, b"z", True)], 3)
    assert {r.request_id: r.content for r in spark.read.parquet(log).where("batch = 3").collect()} == {2: "yz"}
    assert table.rows().count() > 0                                                  # deltas were folded on the way


def test_pieces_of_an_earlier_answer_stay_apart(spark):
    updates, log = shared_path(spark, "test", "updates"), shared_path(spark, "test", "log")
    # Request 1 began in 0 and was given up; it began anew in 1. Request 2 spans 0 to 2; 3 is not finished; no id is an id too.
    for batch, rows in enumerate([[(1, 0, 1, "old", False), (2, 0, 1, "a", False), (None, 0, 1, "n", False)],
                                  [(1, 1, 1, "x", False), (2, 0, 2, "b", False), (3, 1, 1, "z", False)],
                                  [(1, 1, 2, "y", True), (2, 0, 3, "c", True), (None, 0, 2, None, True), (4, 2, 1, "w", True)]]):
        spark.createDataFrame([(*r, False) for r in rows], CH.T.StructType([*CH.OUT_SCHEMA.fields, CH.T.StructField("again", CH.T.BooleanType())])
                              ).write.parquet(f"{updates}/batch={batch}")
    CH.save_finished(spark, updates, log, 2)
    got = {r.request_id: (r.content, r.n_chunks) for r in spark.read.parquet(log).collect()}
    assert got == {1: ("xy", 2), 2: ("abc", 3), None: ("n", 2), 4: ("w", 1)}


def test_stream_keeps_rows_without_text(spark):
    from quillspark.suite.streams import stream_chunk_assemble, stream_result_append
    docs = [(1, "a" * 600), (2, None), (3, ""), (4, "貓" * 200), (4, "貓" * 200)]
    sf = shared_path(spark, "test", "sf")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, stream_chunk_assemble(spark, sf).collect()))
    assert got == [(1, "a" * 600), (2, None), (3, ""), (4, "貓" * 200)]
    saved = sorted(map(tuple, stream_result_append(spark, sf).collect()))
    assert saved == [(i, t, max(1, -(-len((t or "").encode()) // fx.CHUNK_BYTES))) for i, t in got]
