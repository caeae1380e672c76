"""Quality by compression: which of two zstandard dictionaries shortens a text more."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import dropped, fit_logistic, held_out, labelled_sample, released, table

CHUNK = 4096  # bytes compressed at a time, so that the dictionaries matter all through a long text


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


class Sizes:
    """Compressed sizes of a text's chunks under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int = 1):
        import zstandard

        self.compressors = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: bytes) -> list[float]:
        """The normalised difference of the compressed sizes, the size relative to the text, and their product."""
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        good, bad = (sum(len(c.compress(x)) for x in chunks) for c in self.compressors)
        if not chunks:
            return [0.0, 0.0, 0.0]
        diff, ratio = (bad - good) / max(good, bad), min(good, bad) / len(text)
        return [10 * diff, ratio, 10 * diff * ratio]


def fit(rows: list[tuple[str, int]], *, size: int = 64 << 10) -> tuple[bytes, bytes, list[float]]:
    """(good dictionary, bad dictionary, calibration).

    Dictionaries from every other labelled text, the calibration from the rest.
    With one class only, the score is the smoothed rate of label 1.
    """
    import numpy as np

    texts, y = [t.encode() for t, _ in rows], np.array([q for _, q in rows], np.float64)
    rate = (y.sum() + 1) / (len(y) + 2)
    first = np.arange(len(rows)) % 2 == 0
    if min(y[first].sum(), (1 - y[first]).sum(), y[~first].sum(), (1 - y[~first]).sum()) < 2:
        return b"", b"", [0.0, 0.0, 0.0, float(np.log(rate / (1 - rate)))]
    good, bad = (dictionary([t for t, q, d in zip(texts, y, first, strict=True) if d and q == k and t], size) for k in (1, 0))
    sizes = Sizes(good, bad)
    rest = [i for i in range(len(rows)) if not first[i]]
    x = np.array([sizes.features(texts[i]) for i in rest])
    return good, bad, fit_logistic(x, y[rest], l2=1e-4).tolist()


def compression_quality(docs: DataFrame, model: tuple[bytes, bytes, list[float]], *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds ``score_col``: the calibrated probability (0 to 1) that a text is of good quality.

    The whole text is compressed with both dictionaries of ``model``, in chunks of 4
    KiB; the normalised difference of the sizes, weighed by how well the text
    compresses at all, goes through a logistic calibration.  Null and empty texts:
    difference 0.  Each row is scored alone.  An input column of that name is
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import math

        good, bad, w = shared.value
        sizes = Sizes(good, bad)
        for batch in batches:
            out = []
            for text in batch:
                z = w[-1] + sum(a * b for a, b in zip(w, sizes.features((text.as_py() or "").encode()), strict=False))
                out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.array(out, pa.float64())
            released()

    return dropped(docs, [score_col]).withColumn(score_col, score(F.col(text_col)))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame, *, max_train_rows: int = 4000) -> tuple[bytes, bytes, list[float]]:
    """The model of ``labels.quality``; at most ``max_train_rows`` labelled rows, none of them held out."""
    return fit(labelled_sample(docs, table(spark, sf_dir, "labels"), id_col="doc_id", label_col="quality", max_rows=max_train_rows))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and whether it passes 0.3."""
    docs = table(spark, sf_dir, "documents")
    scored = compression_quality(docs.select("doc_id", "text"), quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
