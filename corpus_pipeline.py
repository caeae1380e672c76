"""A training corpus from ``documents``: classify, deduplicate, decontaminate, redact, pack.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import table, written
from sessionloom.llm.decontamination import decontaminated
from sessionloom.llm.jaccard_join import one_of_each
from sessionloom.llm.packing import packed, word_tokenizer
from sessionloom.llm.quality_compression import compression_quality, quality_model
from sessionloom.llm.secrets import redacted

#: Least calibrated probability of good quality that a document needs.
THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    scored = compression_quality(docs, quality_model(spark, sf_dir, docs), score_col="_score")
    return scored.filter(F.col("_score") >= THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the one of least id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by a mark."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows of 4096."""
    return packed(docs.select("doc_id", "text"), tokenizer_path=word_tokenizer())


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: The classifier, the test battery and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of ``documents``, each written out before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
