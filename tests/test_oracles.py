"""Every registered query against its DuckDB oracle (rows-only keys must run)."""

import pytest

from tests.conftest import SF_SMALL
from quillspark import registry
from tests.oracle_check import check

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    status = check(spark, SF_SMALL, [name], verbose=False)[name]
    assert status[0] in ("MATCH", "rows-only"), status
