"""A stored positional index: postings by bucket of their stem, updated by document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.english import ANALYSERS, STOP_WORDS, words
from sessionloom.functions.storage import committed


def document_postings(docs: DataFrame, id_col: str, text_col: str, analyser: str) -> DataFrame:
    """(id, n_words, stem, deltas): of each document and stem its positions, each less the one before (the first as it is)."""

    @F.arrow_udf("array<struct<stem: string, deltas: array<int>>>")
    def analysed(lists: pa.Array) -> pa.Array:
        stop, stem_of, out = set(STOP_WORDS), ANALYSERS[analyser], []
        for each in lists.to_pylist():
            at: dict[str, list[int]] = {}
            for i, w in enumerate(each or []):
                if w not in stop:
                    at.setdefault(stem_of(w), []).append(i)
            out.append([{"stem": s, "deltas": np.diff(p, prepend=0).tolist()} for s, p in sorted(at.items())])
        return pa.array(out, pa.list_(pa.struct([("stem", pa.string()), ("deltas", pa.list_(pa.int32()))])))

    w = docs.select(F.col(id_col).alias("id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    return w.select("id", F.size("w").alias("n_words"), F.explode(analysed("w")).alias("p")).select("id", "n_words", "p.stem", "p.deltas")


def bucket_of(stem, buckets: int):
    return F.pmod(F.xxhash64(stem), F.lit(buckets)).cast("int")


def generations(spark: SparkSession, path: str) -> list[int]:
    """The generations written whole: one's documents are written after its postings."""
    return committed(spark, f"{path}/documents", "generation")


def index_documents(docs: DataFrame, path: str, *, id_col: str = "id", text_col: str = "text", analyser: str = "porter2", buckets: int = 64, removed: DataFrame | None = None) -> int:
    """Add the documents to the index in ``path``, or replace those that are there; returns the generation that holds them.

    Only the given documents' rows are written, as a generation of their own:
    postings by bucket, then the list of its documents.  Readers take of each document
    its last generation, so nothing written before is touched, and a write that ends
    halfway is never seen.  ``removed``: ids of documents that go.  Ids are unique;
    texts that are null or without words are documents without postings.
    """
    spark = docs.sparkSession
    gen = max(generations(spark, path), default=-1) + 1
    p = document_postings(docs, id_col, text_col, analyser).withColumn("bucket", bucket_of(F.col("stem"), buckets))
    p.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "stem", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/generation={gen}")
    listed = docs.select(F.col(id_col).alias("id"), F.size(words(F.coalesce(F.col(text_col), F.lit("")))).alias("n_words"))
    if removed is not None:
        listed = listed.unionByName(removed.select(F.col(id_col).alias("id"), F.lit(None).cast("int").alias("n_words")))
    listed.write.mode("overwrite").parquet(f"{path}/documents/generation={gen}")
    return gen


def indexed_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, n_words, generation) of the documents that are there, each with its last generation."""
    d = spark.read.option("basePath", f"{path}/documents").parquet(*[f"{path}/documents/generation={g}" for g in generations(spark, path)])
    newest = d.groupBy("id").agg(F.max(F.struct("generation", "n_words")).alias("m"))
    return newest.select("id", "m.n_words", "m.generation").filter("n_words is not null")


def looked_up(spark: SparkSession, path: str, terms: DataFrame, *, buckets: int = 64) -> DataFrame:
    """(id, pos, stem, n_words) of the postings of the stems in ``terms``: what ``text.matches`` and ``text.ranked`` read.

    The buckets of those stems, ``buckets`` numbers at most, become a filter on
    partitions: no other bucket is opened.
    """
    wanted = terms.select("stem").distinct()
    own = [r[0] for r in wanted.select(bucket_of(F.col("stem"), buckets).alias("b")).distinct().collect()]
    p = spark.read.option("basePath", f"{path}/postings").parquet(*[f"{path}/postings/generation={g}" for g in generations(spark, path)])
    p = p.filter(F.col("bucket").isin(own)).join(wanted, "stem", "left_semi")
    live = p.join(indexed_documents(spark, path).select("id", "generation"), ["id", "generation"], "left_semi")

    @F.arrow_udf("array<int>")
    def positions(lists: pa.Array) -> pa.Array:
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0] if len(at) else at
        runs = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy().astype(np.int64))])
        out = runs[1:] - np.repeat(runs[at[:-1]], np.diff(at))
        return pa.ListArray.from_arrays(at.astype(np.int32), pa.array(out.astype(np.int32)))

    return live.select("id", F.explode(positions("deltas")).alias("pos"), "stem", "n_words")
