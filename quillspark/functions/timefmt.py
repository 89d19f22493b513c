"""Time helpers (S25-S29) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import schemas as S


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """``Math.round(end - start)`` in milliseconds (half rounds up)."""
    return F.floor((micros(end) - micros(start)) / F.lit(1000.0) + F.lit(0.5)).cast("long")


def display_or_never(ts: Column, fmt: str = "yyyy-MM-dd HH:mm") -> Column:
    """Formatted time, or the 'never used' label for NULL."""
    return F.coalesce(F.date_format(ts, fmt), F.lit(S.NEVER_USED_LABEL))


def newer_than(ts: Column, as_of: Column, days: int) -> Column:
    """strictly newer than ``as_of - days``."""
    return ts > as_of - F.expr(f"INTERVAL {int(days)} DAYS")
