"""Segments joined to their sessions are dealt by the table's size."""

import pytest
from pyspark.sql import functions as F

from sessionloom.plans import relational


@pytest.mark.parametrize("part_rows", [50, 400])
def test_a_part_holds_its_share_whatever_the_size_of_the_table(spark, sf, part_rows):
    s = relational.segments(spark, sf, part_rows)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    most = s.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 3 * part_rows + 50 < n
    assert s.count() == n
