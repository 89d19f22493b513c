"""Content operators: PAA extraction (G1), compliance flags (G2, G3),
prompt assembly (G8) and question-list transport (G14).

All are narrow (per-row) transformations except ``serp_documents``, which
groups the long PAA rows of a run into its item array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import schemas as S
from quillspark.functions import codec
from quillspark.functions import templates as tpl
from quillspark.functions.strings import contains_text, first_truthy, js_is_blank

PAA_ITEMS = T.ArrayType(S.PAA_ITEM)


def serp_documents(items: DataFrame, run: str = "conv_id", pos: str = "turn") -> DataFrame:
    """Long PAA rows -> one SERP item per run with ``peopleAlsoAsk`` in ``pos`` order.

    ``collect_list`` aggregates partially on the map side; the struct carries
    only the four short PAA fields plus the position.
    """
    entry = F.struct(F.col(pos).alias("pos"),
                     F.struct("question", "title", "text", "query").alias("item"))
    g = items.groupBy(run).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return g.select(run, F.transform("_e", lambda e: e["item"]).alias("peopleAlsoAsk"))


def paa_questions(items: Column) -> Column:
    """G1 on one item array: first truthy field per entry, blanks dropped, order kept."""
    arr = F.coalesce(items, F.array().cast(PAA_ITEMS))
    picked = F.transform(arr, lambda p: first_truthy(p["question"], p["title"], p["text"], p["query"]))
    return F.filter(picked, lambda q: ~js_is_blank(q))


def extract_paa(serp: DataFrame, items: str = "peopleAlsoAsk", out: str = "paa") -> DataFrame:
    """G1: add the question list extracted from a SERP item."""
    return serp.withColumn(out, paa_questions(F.col(items))).drop(items)


def paa_context(paa: Column) -> Column:
    """The PAA context line of every prompt (or the no-PAA note)."""
    return F.when(F.size(F.coalesce(paa, F.array().cast("array<string>"))) > 0,
                  F.concat(F.lit(S.PAA_CONTEXT_PREFIX), F.array_join(paa, ", "))
                  ).otherwise(F.lit(S.NO_PAA_NOTE))


def compliance_flags(df: DataFrame, content: str = "content") -> DataFrame:
    """Table / bullet / heading / BLUF flags; all NULL for NULL or empty content."""
    c = F.col(content)
    present = c.isNotNull() & (c != "")

    def flag(e: Column) -> Column:
        return F.when(present, e)

    return df.select(
        *[x for x in df.columns if x != content],
        flag(contains_text(c, "|") & contains_text(c, "---")).alias("has_table"),
        flag(contains_text(c, "- ") | contains_text(c, "* ")).alias("has_bullet"),
        flag(contains_text(c, "## ")).alias("has_heading"),
        flag(~F.startswith(c, F.lit("#"))).alias("has_bluf"))


def compliance_summary(flags: DataFrame, by: str = "keyword") -> DataFrame:
    """Pass counts per flag and group (partial + final hash aggregate)."""
    return flags.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_results"),
        F.count("has_bluf").alias("n_checked"),
        F.count_if(F.col("has_table")).alias("n_table"),
        F.count_if(F.col("has_bullet")).alias("n_bullet"),
        F.count_if(F.col("has_heading")).alias("n_heading"),
        F.count_if(F.col("has_bluf")).alias("n_bluf"))


def stream_prompt(keyword: Column, paa: Column, custom_prompt: Column) -> Column:
    """G8, stream policy: default template, or the custom one when a prompt is given."""
    ctx = paa_context(paa)
    return F.when(custom_prompt.isNotNull() & (custom_prompt != ""),
                  tpl.render(tpl.STREAM_CUSTOM_PROMPT, keyword=keyword, paa_context=ctx,
                             custom_prompt=custom_prompt)
                  ).otherwise(tpl.render(tpl.STREAM_PROMPT, keyword=keyword, paa_context=ctx))


def draft_prompt(keyword: Column, paa: Column) -> Column:
    """G8, pipeline stage 1."""
    return tpl.render(tpl.DRAFT_PROMPT, keyword=keyword, paa_context=paa_context(paa))


def rewrite_prompt(draft: Column, custom_prompt: Column) -> Column:
    """G8, pipeline stage 2: default rewrite, or the custom prompt around the draft."""
    return F.when(custom_prompt.isNotNull() & (custom_prompt != ""),
                  tpl.render(tpl.CUSTOM_REWRITE_PROMPT, custom_prompt=custom_prompt, draft=draft)
                  ).otherwise(tpl.render(tpl.REWRITE_PROMPT, draft=draft))


def refine_prompt(original: Column, refinement: Column) -> Column:
    """G8, refine policy."""
    return tpl.render(tpl.REFINE_PROMPT, original=original, refinement=refinement)


def assemble_prompts(req: DataFrame, keyword: str = "keyword", paa: str = "paa",
                     custom_prompt: str = "custom_prompt") -> DataFrame:
    """G8 over a request table that already carries its PAA list."""
    k, p, cp = F.col(keyword), F.col(paa), F.col(custom_prompt)
    return req.withColumns({
        "paa_context": paa_context(p),
        "draft_prompt": draft_prompt(k, p),
        "stream_prompt": stream_prompt(k, p, cp),
    })


def pack_paa(df: DataFrame, paa: str = "paa", out: str = "paa_header") -> DataFrame:
    """G14 server side: list -> Base64 header value (NULL when empty)."""
    return df.withColumn(out, codec.pack_list(F.col(paa)))


def unpack_paa(df: DataFrame, header: str = "paa_header", out: str = "paa_received") -> DataFrame:
    """G14 client side: header -> list; missing or bad header -> []."""
    return df.withColumn(out, codec.unpack_list(F.col(header)))
