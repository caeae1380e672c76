"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import pytest

import __spark_entry__ as entry
from oracle import connection, same
from sessionloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        same(got, duck.sql(catalog.ORACLES[name]))
    else:
        assert got.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_first_match_headline_of_all_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null")
    assert docs.filter("lang != 'en'").count() > 0
    assert catalog.QUERIES["first_match_headline"](spark, sf).count() == docs.count()
