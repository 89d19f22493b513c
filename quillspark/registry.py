"""Registry of named queries: each runs one operator over the fixture inputs.

``query(name, sql=...)`` registers a ``(spark, sf_dir) -> DataFrame``
callable and, where the result is expressible in SQL, its DuckDB oracle.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

_SUITE_MODULES = (
    "quillspark.suite.content",
    "quillspark.suite.scans",
    "quillspark.suite.keywords",
    "quillspark.suite.usage",
    "quillspark.suite.results",
    "quillspark.suite.plans",
    "quillspark.suite.dml",
    "quillspark.suite.streams",
    "quillspark.suite.policies",
    "quillspark.suite.files",
    "quillspark.suite.checked",
)


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load() -> None:
    for m in _SUITE_MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
