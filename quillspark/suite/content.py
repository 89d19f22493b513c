"""Registered queries: content operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.functions import codec
from quillspark.functions import templates as tpl
from quillspark.operators import content as C
from quillspark.operators import results as R
from quillspark.registry import query
from quillspark.sources import fixtures as fx
from quillspark.sources.fixture_sql import RUN_COUNT, with_views
from quillspark.sources.tables import Tables

_FLAGS_SQL = """
SELECT id, keyword,
       CASE WHEN content <> '' THEN contains(content, '|') AND contains(content, '---') END AS has_table,
       CASE WHEN content <> '' THEN contains(content, '- ') OR contains(content, '* ') END AS has_bullet,
       CASE WHEN content <> '' THEN contains(content, '## ') END AS has_heading,
       CASE WHEN content <> '' THEN NOT starts_with(content, '#') END AS has_bluf
FROM results_v"""


@query("compliance_flags", with_views("results_v") + _FLAGS_SQL)
def compliance_flags(spark, sf):
    t = Tables(spark, sf)
    return C.compliance_flags(fx.results(t).select("id", "keyword", "content"))


@query("compliance_summary", with_views("results_v", extra={"flags": _FLAGS_SQL}) + """
SELECT keyword, count(*) AS n_results, count(has_bluf) AS n_checked,
       CAST(count_if(has_table) AS BIGINT) AS n_table, CAST(count_if(has_bullet) AS BIGINT) AS n_bullet,
       CAST(count_if(has_heading) AS BIGINT) AS n_heading, CAST(count_if(has_bluf) AS BIGINT) AS n_bluf
FROM flags GROUP BY keyword""")
def compliance_summary(spark, sf):
    t = Tables(spark, sf)
    return C.compliance_summary(C.compliance_flags(fx.results(t).select("id", "keyword", "content")))


@query("paa_extract", with_views("paa_v") + "SELECT conv_id, paa FROM paa_v")
def paa_extract(spark, sf):
    t = Tables(spark, sf)
    return C.extract_paa(C.serp_documents(fx.serp_items(t)))


def _ctx_sql(paa: str) -> str:
    return (f"CASE WHEN len(coalesce({paa}, []::VARCHAR[])) > 0 THEN "
            f"{tpl.sql_literal(S.PAA_CONTEXT_PREFIX)} || array_to_string({paa}, ', ') "
            f"ELSE {tpl.sql_literal(S.NO_PAA_NOTE)} END")


_CTX = _ctx_sql("p.paa")


@query("prompt_assemble", with_views("requests_v", "paa_v") + f"""
SELECT r.request_id, {_CTX} AS paa_context,
       {tpl.render_sql(tpl.DRAFT_PROMPT, keyword="r.keyword", paa_context=_CTX)} AS draft_prompt,
       CASE WHEN r.custom_prompt <> ''
            THEN {tpl.render_sql(tpl.STREAM_CUSTOM_PROMPT, keyword="r.keyword", paa_context=_CTX,
                                 custom_prompt="r.custom_prompt")}
            ELSE {tpl.render_sql(tpl.STREAM_PROMPT, keyword="r.keyword", paa_context=_CTX)} END AS stream_prompt
FROM requests_v r LEFT JOIN paa_v p ON p.conv_id = r.request_id % {RUN_COUNT}""")
def prompt_assemble(spark, sf):
    t = Tables(spark, sf)
    req = fx.requests(t)
    j = req.withColumn("conv_id", F.col("request_id") % fx.run_count(t)).join(fx.paa_runs(t), "conv_id", "left")
    return C.assemble_prompts(j).select("request_id", "paa_context", "draft_prompt", "stream_prompt")


@query("paa_transport", with_views("paa_v") + """
SELECT conv_id,
       CASE WHEN len(paa) > 0 THEN to_base64(encode(to_json(paa))) END AS paa_header,
       paa AS paa_received
FROM paa_v""")
def paa_transport(spark, sf):
    t = Tables(spark, sf)
    p = C.extract_paa(C.serp_documents(fx.serp_items(t)))
    return C.unpack_paa(C.pack_paa(p)).select("conv_id", "paa_header", "paa_received")


@query("history_cards", with_views("results_full_v") + """
SELECT id, keyword, CAST(len(coalesce(paa_questions, []::VARCHAR[])) AS INTEGER) AS paa_count,
       paa_questions[1] AS first_question,
       coalesce(substring(content, 1, 150), '') || '...' AS preview
FROM results_full_v""")
def history_cards(spark, sf):
    t = Tables(spark, sf)
    return R.history_cards(fx.results_full(t))


# A text garbles exactly when some character takes more than one byte.
@query("mojibake_check", """
SELECT doc_id, strlen(text) <> length(text) AS garbled_by_latin1, strlen(text) > length(text) AS has_multibyte
FROM documents""")
def mojibake_check(spark, sf):
    """Which texts a Latin-1 reader would garble."""
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", "text")
    bad = codec.latin1_misdecode(F.col("text"))
    return d.select("doc_id", (bad != F.col("text")).alias("garbled_by_latin1"),
                    (F.octet_length("text") > F.length("text")).alias("has_multibyte"))
