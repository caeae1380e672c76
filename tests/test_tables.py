"""Publication, tiers over a stream, numbering: what readers see, also after writes that end halfway."""

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import tables as tb
from sessionloom.operators import vectors as ve

ROW = "pipeline string, session_id string, v int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def seen(spark, path):
    return rows(tb.published(spark, path).select("pipeline", "session_id", "v"))


def test_publication_in_versions(spark, tmp_path):
    path = f"file://{tmp_path}"
    make = lambda *r: spark.createDataFrame(list(r), ROW)
    assert tb.publish(make(("asr", "a", 1), ("asr", "a", 2), ("asr", "b", 3), ("tags", "a", 4)), path) == 0
    assert seen(spark, path) == [("asr", "a", 1), ("asr", "a", 2), ("asr", "b", 3), ("tags", "a", 4)]
    # rows of a new version without their marks: a write that was cut off
    make(("asr", "a", 9)).write.partitionBy("pipeline").parquet(f"{path}/rows/publication=1")
    assert len(seen(spark, path)) == 4
    # a new version takes the place of the whole old output, and withdraws what was made from it, in one step
    assert tb.publish(make(("asr", "a", 7)), path, downstream=make(("tags", "a", 0), ("tags", "z", 0))) == 1
    assert seen(spark, path) == [("asr", "a", 7), ("asr", "b", 3)]
    pending = tb.pending(make(("tags", "a", 0), ("tags", "b", 0)), tb.marked(spark, path), ["pipeline", "session_id"], [])
    assert rows(pending.select("session_id")) == [("a",), ("b",)]
    # a key whose output is empty now; a version done again
    assert tb.publish(spark.createDataFrame([], ROW), path, whole=make(("asr", "b", 0))) == 2
    assert seen(spark, path) == [("asr", "a", 7)]
    assert tb.publish(make(("asr", "a", 100)), path, version=2) == 2
    assert seen(spark, path) == [("asr", "a", 7)]
    assert rows(tb.marked(spark, path)) == [("asr", "a", 1), ("asr", "b", 2)]


def test_tier_over_a_growing_folder(spark, tmp_path):
    schema, calls = "session_id string, version int, text string", []

    def process(batch):
        calls.extend(tuple(r) for r in batch.select("session_id", "version").collect())
        return batch.select(F.lit("asr").alias("pipeline"), "session_id", "version", F.upper("text").alias("text")).filter("text != 'NONE'")

    given = [[("a", 1, "one"), ("b", 1, "two")], [("a", 2, "three"), ("a", 3, "four"), ("c", 1, "none")], [], [("b", 2, "none"), ("d", 1, "five")]]
    for i, part in enumerate(given):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("pipeline", F.lit("asr"))
        tb.tier_stream(source, f"file://{tmp_path}/out", f"{tmp_path}/check", process, key=("pipeline", "session_id"), order="version").awaitTermination()
    got = tb.published(spark, f"file://{tmp_path}/out").select("session_id", "version", "text")
    assert rows(got) == [("a", 3, "FOUR"), ("d", 1, "FIVE")]
    assert sorted(calls) == [("a", 1), ("a", 3), ("b", 1), ("b", 2), ("c", 1), ("d", 1)]
    assert {r[1] for r in rows(tb.marked(spark, f"file://{tmp_path}/out"))} == {"a", "b", "c", "d"}


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbering_without_one_partition(spark, n):
    df = spark.range(n).select(F.pmod(F.col("id") * 37, F.lit(1009)).alias("x")).repartition(7)
    got = tb.numbered(df, ["x"])
    assert [r["number"] for r in got.orderBy("x").collect()] == list(range(n))
    assert "SinglePartition" not in tb.numbered(df, ["x"]).filter("number = 1")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    want = sorted(r["x"] for r in df.collect())
    assert [r["x"] for r in tb.strided(df, ["x"], 30).orderBy("x").collect()] == want[:: max(1, -(-n // 30))]


def test_nearest_by_blocks(spark):
    import numpy as np

    r = np.random.default_rng(8)
    x = r.normal(size=(300, 6))
    x[17] = x[3]
    data = [(i, "ab"[i % 2], [float(v) for v in x[i]] if i != 50 else None) for i in range(300)]
    df = spark.createDataFrame(data, "id long, model string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for group in (None, "model"):
        got = {}
        for row in ve.nearest(df, df.filter("id % 10 = 3"), 4, id_col="id", vector_col="v", group=group, block_rows=40).collect():
            got.setdefault(row["query_id"], {})[row["rank"]] = row["id"]
        for q in range(3, 300, 10):
            others = [i for i in range(300) if i != 50 and (group is None or i % 2 == q % 2)]
            want = sorted(others, key=lambda i: (round(1 - u[q] @ u[i], 12), i))[:4]
            assert [got[q][k] for k in (1, 2, 3, 4)] == want
        assert len(got) == 30
    assert ve.nearest(df, df.limit(0), 4, id_col="id", vector_col="v").count() == 0
