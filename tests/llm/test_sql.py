"""Training-data queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from oracle import connection, same
from sessionloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connection(sf).sql(queries.ORACLES[name]))
