"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.storage import written

BATCH = 4 << 20  # bytes of an Arrow batch in ``small_batches``


def dropped(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without its columns called like an operator's own outputs: the operator's replace them."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.drop(*clash) if clash else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so: for an operator's inner columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released() -> None:
    """Give freed memory back to the system: Python workers are used again and would keep the peak of all that ran in them."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f`` of a DataFrame, which runs all its jobs before it returns, with Arrow batches of about ``BATCH`` bytes or one row.

    Spark's own bound is a number of rows, so a worker and the executor beside it would
    hold whole batches of long texts; and an executor has more workers than cores, as
    every Python step of a running stage has its own and idle ones are kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    @functools.wraps(f)
    def bounded(docs: DataFrame, *args, **how) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(key, None)
        conf.set(key, str(BATCH))
        try:
            return f(docs, *args, **how)
        finally:
            conf.set(key, before) if before is not None else conf.unset(key)

    return bounded


__all__ = ["dropped", "free_name", "fit_logistic", "held_out", "labelled_sample", "released", "small_batches", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.col:
    """True for the fifth of the documents whose labels no model may learn."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, max_rows: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``max_rows`` labelled documents, spread by a hash of the id.

    The labels are cut to the bound first, so that only chosen documents are read
    whole.  Rows with a null id or label, and held-out ids, take no part; of
    conflicting labels of one id the smallest counts.
    """
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .orderBy(F.xxhash64("_id"), "_id", "_text")
        .limit(max_rows)
        .select("_text", "_label")
        .collect()
    )
    return [(r[0], r[1]) for r in rows]


def fit_logistic(x, y, *, l2: float = 1e-3, steps: int = 60):
    """Weights (last: bias) of a logistic regression by damped Newton steps on a small dense matrix."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2 * max(len(x), 1))
    reg[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + reg * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg + 1e-6)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
