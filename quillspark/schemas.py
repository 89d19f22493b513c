"""Table schemas of the application data model and its fixed values.

UUID columns become STRING (or a BIGINT surrogate in the fixtures), JSONB
question lists become ARRAY<STRING>.  Spark enforces no UNIQUE / FK /
DEFAULT; the write operators in ``operators/`` do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the application's for identical results.
# ---------------------------------------------------------------------------
DEFAULT_MODEL = "gemini-2.5-flash"
REFINE_MODELS = ["gemini-2.5-flash", "gemini-2.5-pro", "gemini-3-flash-preview"]
CACHED_MODEL_LABEL = "cached"
UNKNOWN_KEYWORD = "Unknown"
DEFAULT_MAX_USAGE = 10
ADMIN_MAX_USAGE = 999999
MAX_KEYWORD_LENGTH = 100
HISTORY_LIMIT = 20
RECENT_USAGE_LIMIT = 10
CARD_PREVIEW_CHARS = 150
MISSING_FILE_SENTINEL = "Error: Excel_Not_Found"
FALLBACK_KEYWORDS = ["滴雞精推薦", "葉黃素功效", "益生菌怎麼吃", "魚油推薦", "維他命C"]
NEVER_USED_LABEL = "從未使用"
PREMIUM_LABEL = "👑 Premium"
REGULAR_LABEL = "一般用戶"
REPORT_LABEL_ADMIN = "🔑 管理員"
REPORT_LABEL_TEST = "👤 普通用戶"
REPORT_LABEL_OTHER = "👥 一般用戶"
NO_PAA_NOTE = "Note: No PAA data found. Infer user intent from keyword directly."
PAA_CONTEXT_PREFIX = "Real User Questions (PAA): "
# Validation / status messages of the keyword and quota operators.
MSG_LOGIN_REQUIRED = "請先登入"
MSG_NOT_PREMIUM = "普通用戶無法新增關鍵字。請聯繫管理員升級為 Premium 用戶。"
MSG_EMPTY_KEYWORD = "關鍵字不能為空"
MSG_TOO_LONG = "關鍵字長度不能超過 100 個字符"
MSG_DUPLICATE = "此關鍵字已存在"
MSG_ADDED = "關鍵字新增成功"
MSG_PIPELINE_LOGIN = "請先登入系統"
MSG_QUOTA_BEFORE, MSG_QUOTA_AFTER = "您已達到使用次數上限 (", ")。請聯繫管理員以獲得更多使用次數。聯繫信箱："
MSG_CRAWL_FAILED = "Apify 執行失敗"
MSG_GENERATION_FAILED = "AI 生成失敗"
CONTACT = "admin@example.com"      # a parameter of run_pipeline, not a real address
# ---------------------------------------------------------------------------

UUID = T.StringType()

USER_USAGE = T.StructType([
    T.StructField("id", UUID, False, {"comment": "primary key"}),
    T.StructField("user_id", T.LongType(), True, {"comment": "unique; references users, cascade"}),
    T.StructField("email", T.StringType(), True),
    T.StructField("usage_count", T.IntegerType(), True, {"default": "0"}),
    T.StructField("max_usage", T.IntegerType(), True, {"default": "10"}),
    T.StructField("is_premium", T.BooleanType(), True, {"default": "false"}),
    T.StructField("created_at", T.TimestampType(), True, {"default": "now()"}),
    T.StructField("last_used_at", T.TimestampType(), True),
])

CONTENT_REFINEMENTS = T.StructType([
    T.StructField("id", UUID, False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("original_content", T.StringType(), False),
    T.StructField("refinement_prompt", T.StringType(), False),
    T.StructField("refined_content", T.StringType(), False),
    T.StructField("model_used", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True, {"default": "now()"}),
])

ANALYSIS_RESULTS = T.StructType([
    T.StructField("id", UUID, False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("paa_questions", T.ArrayType(T.StringType()), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True, {"default": "now()"}),
])

USER_KEYWORDS = T.StructType([
    T.StructField("id", UUID, False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("keyword", T.StringType(), False, {"comment": "unique per user"}),
    T.StructField("created_at", T.TimestampType(), True, {"default": "now()"}),
    T.StructField("updated_at", T.TimestampType(), True, {"default": "now()"}),
])

PAA_ITEM = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("query", T.StringType()),
])

SERP_ITEM = T.StructType([T.StructField("peopleAlsoAsk", T.ArrayType(PAA_ITEM))])

ANALYSE_REQUEST = T.StructType([
    T.StructField("keyword", T.StringType()),
    T.StructField("selectedModel", T.StringType()),
    T.StructField("customPrompt", T.StringType()),
    T.StructField("forceRefresh", T.BooleanType()),
])

REFINE_REQUEST = T.StructType([
    T.StructField("originalContent", T.StringType()),
    T.StructField("refinementPrompt", T.StringType()),
    T.StructField("keyword", T.StringType()),
])

TABLES = {
    "user_usage": USER_USAGE,
    "content_refinements": CONTENT_REFINEMENTS,
    "analysis_results": ANALYSIS_RESULTS,
    "user_keywords": USER_KEYWORDS,
}


def fill_defaults(rows: DataFrame, table: T.StructType, target: T.StructType, now: Column) -> DataFrame:
    """``rows`` with the columns of ``target``; a column that an insert does
    not name takes the table's default, else NULL.  ``now`` stands for now()."""
    defaults = {f.name: f.metadata.get("default") for f in table.fields}

    def value(f: T.StructField) -> Column:
        if f.name in rows.columns:
            return F.col(f.name)
        d = defaults.get(f.name)
        return now if d == "now()" else F.lit(d)
    return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in target.fields])
