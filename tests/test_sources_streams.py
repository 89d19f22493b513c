"""Keyword-file source (SRC1) and the streaming text decoder."""

from pyspark.sql import functions as F

from quillspark.operators.keywords import read_keyword_file
from quillspark.session import shared_path
from quillspark.streaming.chunks import decode_piece
from quillspark.streaming.runner import stage_files
from tests.conftest import SF_SMALL


def test_keyword_csv_keeps_order_duplicates_and_drops_empty(spark):
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet").orderBy("p_partkey")
    rows = part.select(F.when(F.col("p_partkey") % 10 == 3, F.lit("")).otherwise(F.col("p_name"))
                       .alias("Keyword"), F.col("p_brand").alias("Brand"))
    path = shared_path(spark, "test", "keywords_csv")
    rows.coalesce(1).write.option("header", True).csv(path)
    got = read_keyword_file(spark, path, "csv").orderBy("pos").collect()
    want = [r.Keyword for r in rows.collect() if r.Keyword]
    assert [r.keyword for r in got] == want                      # file order, duplicates kept
    assert len(want) < rows.count()                              # empty cells were dropped


def test_split_character_is_held_back_until_complete():
    b = "貓咪".encode("utf-8")                                   # 6 bytes, 3 per character
    text, held = decode_piece(b"", b[:4], False)
    assert (text, held) == ("貓", b[3:4])
    assert decode_piece(held, b[4:], False) == ("咪", b"")
    assert decode_piece(held, b[4:5], True) == ("\ufffd", b"")   # a truncated tail becomes U+FFFD
    assert decode_piece(b"", b"a\xffb", False) == ("a\ufffdb", b"")


def test_stage_files_splits_in_order(spark):
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts")
    path = stage_files(df, "test-stage", "ts")
    back = spark.read.parquet(path)
    assert back.count() == df.count()
    assert back.select(F.input_file_name()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_running_text_is_always_a_prefix_of_the_answer(spark):
    from quillspark.streaming import chunks as CH
    from quillspark.suite.streams import _chunk_stream
    updates, log = _chunk_stream(spark, SF_SMALL)
    ups = CH.running_text(CH.update_log(spark, updates))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").alias("request_id"), "text")
    rows = ups.join(docs.withColumnRenamed("text", "final"), "request_id").collect()
    partial = [r for r in rows if not r.done]
    assert partial, "some answers must span several micro-batches"
    assert all(r.final.startswith(r.text) for r in rows)
    assert all(r.text == r.final for r in rows if r.done)
    # Each finished answer is saved exactly once
    saved = spark.read.parquet(log)
    assert saved.count() == saved.select("request_id").distinct().count() == docs.count()


def test_keyword_files_are_read_in_file_order(spark):
    import pandas as pd
    path = shared_path(spark, "test", "keyword_files")
    for name, n in (("a", 2), ("b", 200)):
        spark.createDataFrame(pd.DataFrame({"Keyword": [f"{name}{i}" for i in range(n)]})).coalesce(1).write.option(
            "header", True).csv(f"{path}/part={name}")
    got = [r.keyword for r in read_keyword_file(spark, path, "csv").orderBy("pos").collect()]
    assert got == ["a0", "a1"] + [f"b{i}" for i in range(200)]


def test_redelivered_chunks_leave_no_state(spark):
    from quillspark.streaming import chunks as CH

    class State:
        value, hasTimedOut, exists = None, False, False

        @property
        def get(self):
            return self.value

        def update(self, v):
            self.value, self.exists = v, True

        def setTimeoutDuration(self, ms):
            self.timeout = ms

        def remove(self):
            self.value, self.exists = None, False

    import pandas as pd
    state = State()

    def deliver(*chunks):
        pdf = pd.DataFrame(chunks, columns=["chunk_no", "chunk", "is_last"])
        return [r for out in CH._assemble((1,), iter([pdf]), state) for r in out.to_dict("records")]

    assert deliver((0, b"ab", False))[0]["added"] == "ab"
    assert deliver((0, b"ab", False))[0]["added"] == "" and not state.value[4]        # nothing waits
    assert deliver((3, "é".encode()[1:], True))[0]["added"] == "" and state.value[4] == [3]
    assert b"ab" not in str(state.value).encode()                                      # the text is not in the state
    assert deliver((1, b"cd", False))[0]["added"] == "cd"
    done = deliver((2, "é".encode()[:1], False))[0]
    assert (done["added"], done["done"], done["n_chunks"]) == ("é", True, 4)
    assert deliver((1, b"cd", False)) == [] and state.value[3] == b"" and state.timeout == CH.FINISHED_MS
    state.hasTimedOut = True
    assert deliver((1, b"cd", False)) == [] and not state.exists


def test_quota_batches_replay_and_take_null_limits(spark):
    from quillspark.streaming.quota import current, fold, quota_batch_writer, start_usage
    usage = spark.createDataFrame([(1, "a", 8, 10, False, None, None), (2, "b", 0, None, False, None, None)],
                                  "user_id long, email string, usage_count long, max_usage int, is_premium boolean, "
                                  "created_at timestamp_ntz, last_used_at timestamp_ntz")
    base, out = shared_path(spark, "test", "quota"), shared_path(spark, "test", "quota_out")
    table = start_usage(usage, base, 4)
    apply = quota_batch_writer(table, out)
    rows = [(i, 1 + i % 2, None) for i in range(8)]
    batches = [spark.createDataFrame(part, "request_id long, user_id long, ts timestamp_ntz") for part in (rows[:4], rows[4:])]
    for k in (0, 0, 1, 1):
        apply(batches[k], k)
    got = {r.request_id: r.admitted for r in spark.read.parquet(out).collect()}
    assert [got[i] for i in (0, 2, 4, 6)] == [True, True, False, False]        # two left of ten
    assert [got[i] for i in (1, 3, 5, 7)] == [None] * 4
    assert {r.user_id: r.usage_count for r in current(table).collect()} == {1: 10, 2: 0}
    assert {r.user_id: r.usage_count for r in table.rows().collect()} == {1: 8, 2: 0}       # only deltas were written
    assert table.compact(lambda rows, deltas: fold(rows, deltas), after=1) and table.deltas().count() == 0
    assert {r.user_id: r.usage_count for r in table.rows().collect()} == {1: 10, 2: 0}
