"""D17 schemas and S31 ids."""


from quillspark import schemas as S
from quillspark.functions.ids import key_uuid


def test_schema_defaults_and_constraints():
    usage = {f.name: f for f in S.USER_USAGE.fields}
    assert usage["usage_count"].metadata["default"] == "0"
    assert usage["max_usage"].metadata["default"] == "10"
    assert usage["is_premium"].metadata["default"] == "false"
    assert usage["user_id"].nullable and not usage["id"].nullable
    kw = {f.name: f for f in S.USER_KEYWORDS.fields}
    assert not kw["user_id"].nullable and "unique" in kw["keyword"].metadata["comment"]
    assert set(S.TABLES) == {"user_usage", "content_refinements", "analysis_results", "user_keywords"}


def test_key_uuid_is_deterministic_and_distinct(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a")], "u long, k string")
    ids = [r.i for r in df.select(key_uuid("u", "k").alias("i")).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 3
    assert all(len(i) == 36 and i.count("-") == 4 for i in ids)
