"""Row ids for inserted rows.

The application lets the database draw a random UUID per insert.  A random
id is not retry-safe in Spark (a re-run task would draw a new one), so new
rows get a UUID-shaped id derived from their natural key instead: the same
row always gets the same id, in every attempt and on every executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_uuid(*cols) -> Column:
    """8-4-4-4-12 hex id from the MD5 of the key columns (NULL-safe; each part
    carries its length, so no two keys give the same text)."""
    texts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]
    h = F.md5(F.concat(*parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def key_uuid_sql(*exprs: str) -> str:
    """The same id as SQL text (DuckDB / ANSI), for oracles."""
    texts = [f"CAST({e} AS VARCHAR)" for e in exprs]
    parts = " || ".join(f"coalesce(CAST(length({x}) AS VARCHAR) || ':' || {x}, '-')" for x in texts)
    h = f"md5({parts})"
    return (f"(substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-' || substring({h}, 13, 4) || '-' "
            f"|| substring({h}, 17, 4) || '-' || substring({h}, 21, 12))")
