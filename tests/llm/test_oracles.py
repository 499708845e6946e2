"""The operators that SQL can express against DuckDB."""

from __future__ import annotations

import pytest

from tests.test_queries import compare, duck  # noqa: F401
from tidegate.llm import queries


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_oracle(spark, duck, name):  # noqa: F811
    compare(spark, duck, queries.queries()[name], queries.oracle_sql()[name])
