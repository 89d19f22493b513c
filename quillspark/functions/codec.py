"""JSON / UTF-8 / Base64 transport of question lists.

Everything is a native expression: no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING_LIST = T.ArrayType(T.StringType())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_base64_unchunked(b: Column) -> Column:
    """Base64 of bytes on one line (Spark wraps at 76 chars by default)."""
    return F.translate(F.base64(b), "\r\n", "")


def pack_list(x) -> Column:
    """G14 pack: list -> JSON -> UTF-8 -> Base64; NULL (header omitted) when empty."""
    c = _c(x)
    js = F.to_json(c)
    return F.when(F.size(F.coalesce(c, F.array().cast(STRING_LIST))) > 0,
                  to_base64_unchunked(F.encode(js, "UTF-8")))


def decode_utf8_or_null(b: Column) -> Column:
    """UTF-8 decode that yields NULL for malformed bytes instead of raising."""
    return F.try_validate_utf8(b.cast("string"))


def unpack_list(x) -> Column:
    """S21/G14 unpack: Base64 -> UTF-8 -> JSON list; a bad payload gives []."""
    c = _c(x)
    text = decode_utf8_or_null(F.try_to_binary(c, F.lit("BASE64")))
    parsed = F.from_json(text, STRING_LIST)
    return F.coalesce(parsed, F.array().cast(STRING_LIST))


def latin1_misdecode(x) -> Column:
    """The text a Latin-1 reader makes of UTF-8 bytes (mojibake)."""
    return F.decode(F.encode(_c(x), "UTF-8"), "ISO-8859-1")
