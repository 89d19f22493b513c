"""String and value helpers with the application's (JavaScript) semantics.

All of them return native Column expressions, so they stay inside
whole-stage codegen; none crosses into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the ECMAScript WhiteSpace + LineTerminator set that
# String.prototype.trim removes (tab, LF, VT, FF, CR, space, NBSP, OGHAM SPACE
# MARK, EN QUAD..HAIR SPACE, LINE SEPARATOR, PARAGRAPH SEPARATOR, NNBSP, MMSP,
# IDEOGRAPHIC SPACE, BOM).  Written as a regex class both Java and RE2 accept.
JS_WS_CLASS = (r"[\x{0009}-\x{000D}\x{0020}\x{00A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")
JS_TRIM_PATTERN = rf"^{JS_WS_CLASS}+|{JS_WS_CLASS}+$"
JS_BLANK_PATTERN = rf"^{JS_WS_CLASS}*$"
JS_LEADING_INT_PATTERN = rf"^{JS_WS_CLASS}*([+-]?[0-9]+)"
ASTRAL_PATTERN = r"[^\x{10000}-\x{10FFFF}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(x) -> Column:
    """Trim all Unicode whitespace (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(x), JS_TRIM_PATTERN, "")


def js_is_blank(x) -> Column:
    """True when the string is empty after a JS trim (NULL stays NULL)."""
    return _c(x).rlike(JS_BLANK_PATTERN)


def utf16_length(x) -> Column:
    """JS ``.length`` counts UTF-16 units: code points + one per astral char."""
    c = _c(x)
    return F.length(c) + F.length(F.regexp_replace(c, ASTRAL_PATTERN, ""))


def truthy(x) -> Column:
    """JS truthiness of a string: not NULL and not empty."""
    c = _c(x)
    return c.isNotNull() & (c != "")


def first_truthy(*cols, default: str = "") -> Column:
    """``a || b || ... || default`` — empty strings fall through, blanks do not."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols], F.lit(default))


def default_if_empty(x, default) -> Column:
    """``x || default``."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_c(x), F.lit("")), d)


def prefix(x, n: int) -> Column:
    """JS ``substring(0, n)`` — the first n UTF-16 units; half of a pair at
    the end becomes U+FFFD, as when the text is encoded."""
    units = F.encode(F.substring(_c(x), 1, n), "UTF-16BE")
    split = F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB")
    cut = F.when(split, F.concat(F.decode(F.substring(units, 1, 2 * n - 2), "UTF-16BE"), F.lit("\uFFFD"))
                 ).otherwise(F.decode(F.substring(units, 1, F.lit(2 * n)), "UTF-16BE"))
    return F.when(F.octet_length(units) <= 2 * n, F.substring(_c(x), 1, n)).otherwise(cut)


def parse_int_or_zero(x) -> Column:
    """``parseInt(x) || 0`` — leading (signed) integer (BIGINT), else 0.
    Digits beyond BIGINT give its ends, which no INTEGER column takes."""
    digits = F.regexp_extract(_c(x), JS_LEADING_INT_PATTERN, 1)
    beyond = F.when(F.startswith(digits, F.lit("-")), F.lit(-2**63)).otherwise(F.lit(2**63 - 1))
    v = F.when(digits != "", F.coalesce(digits.try_cast("bigint"), beyond))
    return F.coalesce(v, F.lit(0).cast("bigint"))


def ratio_label(n, d) -> Column:
    """``n/max``."""
    return F.concat_ws("/", _c(n).cast("string"), _c(d).cast("string"))


def contains_text(x, needle: str) -> Column:
    """Substring test with literal semantics (no LIKE wildcards)."""
    return F.contains(_c(x), F.lit(needle))


# The markers that colour an activity-log line.
LOG_OK_MARK = "✅"
LOG_ERROR_MARK = "❌"


def log_severity(msg) -> Column:
    """Ok when the line has the ok marker (tested first), else error, else info."""
    c = _c(msg)
    return (F.when(F.contains(c, F.lit(LOG_OK_MARK)), "ok")
            .when(F.contains(c, F.lit(LOG_ERROR_MARK)), "error").otherwise("info"))
