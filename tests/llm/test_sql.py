"""Queries that SQL can express, against DuckDB."""

import pytest

from promptscreen.llm.queries import QUERIES, SQL
from tests.conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    same_as_sql(QUERIES[name](spark, sf), SQL[name], sf)
