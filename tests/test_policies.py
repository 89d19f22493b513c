"""Row policies and cascades on small tables."""

from pyspark.sql import functions as F

from quillspark.operators import policies as P

ROWS = [(1, "a", 5), (2, "b", 6), (None, "c", 7)]


def rows(spark):
    return spark.createDataFrame(ROWS, "user_id long, name string, n int")


def test_select_update_delete_skip_silently(spark):
    callers = spark.createDataFrame([(1,), (1,), (None,)], "caller long")
    assert [(r.caller, r.name) for r in P.visible(callers, rows(spark), "user_usage").collect()] == [(1, "a")]
    assert P.visible(callers, rows(spark), "unknown_table").count() == 0
    assert P.visible(callers, rows(spark), "analysis_results").count() == 3
    asked = spark.createDataFrame([(1, "a", 1, 50), (1, "a", 2, 60), (1, "b", 3, 70), (None, "c", 4, 80)], "caller long, name string, at int, n int")
    out = P.update_rows(rows(spark), asked, ["name"], {"n": F.col("req.n")}, "user_usage", ["at"])
    assert sorted((r.name, r.n) for r in out.collect()) == [("a", 60), ("b", 6), ("c", 7)]
    # keywords have no UPDATE policy, refinements no DELETE policy; the owner of the table is not checked
    assert sorted(r.n for r in P.update_rows(rows(spark), asked, ["name"], {"n": F.col("req.n")}, "user_keywords", ["at"]).collect()) == [5, 6, 7]
    assert P.delete_rows(rows(spark), asked, ["name"], "content_refinements").count() == 3
    assert P.delete_rows(rows(spark), asked, ["name"], "content_refinements", bypass=True).count() == 0
    assert sorted(r.name for r in P.delete_rows(rows(spark), asked, ["name"], "user_keywords").collect()) == ["b", "c"]


def test_insert_rejects_with_a_code(spark):
    batch = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (1, None)], "user_id long, caller long")
    assert [r.accepted for r in P.insert_check(batch, "user_usage").collect()] == [True, False, False, False]
    assert [r.error_code for r in P.insert_check(batch, "user_usage").collect()] == [None, "42501", "42501", "42501"]
    assert all(r.accepted for r in P.insert_check(batch, "analysis_results").collect())
    assert not any(r.accepted for r in P.insert_check(batch, "unknown_table").collect())


def test_cascade_walks_a_graph_to_its_fixed_point(spark):
    keys = [P.ForeignKey("team", "lead", "person"), P.ForeignKey("task", "team", "team"), P.ForeignKey("task", "parent", "task")]
    tables = {"person": spark.createDataFrame([(1,), (2,)], "id long"),
              "team": spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id long, lead long"),
              "task": spark.createDataFrame([(100, 10, None), (101, 20, 100), (102, 20, 101), (103, 20, None), (104, None, 105), (105, None, 104)],
                                            "id long, team long, parent long")}
    gone = {"person": spark.createDataFrame([(1,)], "id long")}
    out = {t: sorted(r.id for r in df.collect()) for t, df in P.cascade_delete(tables, gone, keys).items()}
    assert out == {"person": [2], "team": [20, 30], "task": [103, 104, 105]}       # 101 and 102 hang on 100
    circle = {"task": spark.createDataFrame([(104,)], "id long")}
    out = P.cascade_delete(tables, circle, keys)
    assert sorted(r.id for r in out["task"].collect()) == [100, 101, 102, 103]
