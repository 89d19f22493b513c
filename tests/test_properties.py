"""Scalar semantics against plain-Python models of the JavaScript behaviour,
on seeded random strings (one Spark job per property), and DML invariants."""

import random
import re

from pyspark.sql import functions as F

from quillspark.functions.strings import (first_truthy, js_is_blank, js_trim, parse_int_or_zero,
                                          utf16_length)
from quillspark.operators import usage as U
from quillspark.sources import fixtures as fx
from quillspark.sources.tables import Tables
from tests.conftest import SF_SMALL

JS_WS = "\t\n\x0b\x0c\r \xa0 " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "    　﻿"
ALPHABET = list(JS_WS) + list("ab 1234567890+-x}") + ["貓", "咪", "🐱", "💰", "é", "​"]


def _strings(n=400, seed=7):
    rnd = random.Random(seed)
    return [None if rnd.random() < 0.03 else "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12)))
            for _ in range(n)]


def _py_parse_int(s):
    if s is None:
        return 0
    m = re.match(r"[" + re.escape(JS_WS) + r"]*([+-]?[0-9]+)", s)
    if not m:
        return 0
    v = int(m.group(1))
    return v if -2**31 <= v < 2**31 else 0


def test_string_scalars_match_js_model(spark):
    vals = _strings()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(vals)], "i int, s string")
    rows = df.select("i", js_trim(F.col("s")).alias("t"), utf16_length(F.col("s")).alias("n"),
                     js_is_blank(F.col("s")).alias("b"), parse_int_or_zero(F.col("s")).alias("p")).collect()
    for r in rows:
        s = vals[r.i]
        if s is None:
            assert r.t is None and r.n is None and r.b is None and r.p == 0
            continue
        assert r.t == s.strip(JS_WS), repr(s)
        assert r.n == len(s.encode("utf-16-le")) // 2, repr(s)
        assert r.b == (s.strip(JS_WS) == ""), repr(s)
        assert r.p == _py_parse_int(s), repr(s)


def test_first_truthy_matches_js_or_chain(spark):
    rnd = random.Random(3)
    opts = [None, "", " ", "a", "貓"]
    rows = [tuple(rnd.choice(opts) for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = [r.v for r in df.select(first_truthy("a", "b", "c", "d").alias("v")).collect()]
    want = [next((x for x in row if x), "") for row in rows]
    assert got == want


def test_signup_upsert_keeps_keys_unique_and_others_untouched(spark):
    t = Tables(spark, SF_SMALL)
    usage, signups = fx.usage(t).select(*U.USAGE_COLS), fx.signups(t)
    nxt = U.signup_upsert(usage, signups, fx.admin_emails(t), fx.test_emails(t), fx.request_start())
    assert nxt.count() == nxt.select("user_id").distinct().count()
    others = usage.join(signups.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    assert others.exceptAll(nxt.select(*U.USAGE_COLS)).count() == 0
    # every signup ends with a usage row carrying its email
    joined = signups.select("id", F.col("email").alias("new_email")).join(
        nxt, F.col("id") == nxt.user_id)
    assert joined.count() == signups.count()
    assert joined.filter(F.col("email") != F.col("new_email")).count() == 0
