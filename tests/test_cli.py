"""Command line entry."""

from quillspark.__main__ import main


def test_list_and_sql(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out.split("\n")
    assert "request_plan_pipeline" in out and "mojibake_check" in out and "catalog_columns  (rows-only)" in out
    assert main(["run", "keyword_stats", "/root/testdata/sf0.001", "--sql"]) == 0
    assert "keywords_per_user" in capsys.readouterr().out
    assert main(["run", "no_such_query", "/tmp"]) == 2
