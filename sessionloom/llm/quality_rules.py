"""Quality rules with a hashed n-gram logistic regression behind them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import dropped, fit_logistic, free_name, labelled_sample, table
from sessionloom.llm.textvec import Hasher, Texts, mixed, slices

OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality_score"]
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality_score double"
SYMBOLS = b"#*$%&|<>"
BITS = 11  # of each hashed feature space


def grams(t: Texts, hasher: Hasher, sums):
    """Hashed features: (feature, text) of words and word pairs, and of runs of four bytes.

    The second space begins after the first.
    """
    import numpy as np

    words = hasher.ranges(sums, t.start, t.stop)
    pairs = mixed(words[:-1] * np.uint64(31) + words[1:])
    same = t.doc[:-1] == t.doc[1:]
    of_words = np.concatenate([words, pairs[same]]) >> np.uint64(64 - BITS)
    doc_words = np.concatenate([t.doc, t.doc[1:][same]])
    d = t.data.astype(np.uint32)
    four = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24) if len(d) > 3 else d[:0]
    of_bytes = (four * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return words, of_words.astype(np.int64), doc_words, of_bytes.astype(np.int64)


def features(texts: list[bytes], hasher: Hasher):
    """Mean of each hashed feature over a text's words and pairs, and over its runs of four bytes."""
    import numpy as np

    t = Texts(texts)
    _, of_words, doc_words, of_bytes = grams(t, hasher, hasher.sums(t.data))
    n, x = len(texts), np.zeros((len(texts), 2 << BITS), np.float32)
    np.add.at(x, (doc_words, of_words), 1.0)
    at = np.arange(len(of_bytes))
    doc = np.searchsorted(t.end, at)
    inside = at + 4 <= t.end[doc]
    np.add.at(x, (doc[inside], of_bytes[inside] + (1 << BITS)), 1.0)
    x[:, : 1 << BITS] /= np.maximum(x[:, : 1 << BITS].sum(1, keepdims=True), 1)
    x[:, 1 << BITS :] /= np.maximum(x[:, 1 << BITS :].sum(1, keepdims=True), 1)
    return x.reshape(n, -1)


def fit(rows: list[tuple[str, int]], *, epochs: int = 300, l2: float = 1e-5):
    """(weights of both spaces, slope, offset): trained on three quarters of ``rows``, calibrated on the rest.

    With one class only, the score is a constant: the smoothed rate of label 1.
    """
    import numpy as np

    y = np.array([q for _, q in rows], np.float64)
    w = np.zeros(2 << BITS, np.float32)
    rate = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(rate / (1 - rate)))
    if len(rows) < 20 or min(y.sum(), len(y) - y.sum()) < 4:
        return w, 0.0, prior
    hasher = Hasher()
    x = np.vstack([features(part, hasher) for _, part in slices([t for t, _ in rows])])
    scale = np.sqrt((x**2).mean(0)) + 1e-4
    x /= scale
    train = np.arange(len(rows)) % 4 != 3
    xt, yt = x[train], y[train].astype(np.float32)
    weight = np.where(yt > 0, 0.5 / max(yt.mean(), 1e-3), 0.5 / max(1 - yt.mean(), 1e-3)).astype(np.float32)
    b, m, v = np.float32(0), np.zeros(w.size + 1, np.float32), np.zeros(w.size + 1, np.float32)
    for i in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(xt @ w + b, -30, 30)))
        r = (p - yt) * weight / len(yt)
        g = np.append(xt.T @ r + l2 * w, r.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    z = x[~train] @ w
    slope, offset = fit_logistic(z[:, None].astype(np.float64), y[~train], l2=1e-2)
    return (w / scale).astype(np.float32), float(slope), float(offset)


def quality_rules(docs: DataFrame, model: tuple, *, text_col: str = "text") -> DataFrame:
    """Counts of each whole text and its calibrated probability of good quality.

    Words are runs without ASCII white space.  Adds n_words, word_chars (code points
    in words), n_symbols (of ``#*$%&|<>``), n_dup_lines (lines with a word equal to
    an earlier line), n_repeat_words (words in windows of three that occur twice or
    more in the text) and quality_score (``model`` as ``fit`` gives it).  Null reads
    as empty: zero counts, the score of no features.  Each row is judged alone, so
    repeated rows get the same answer.  Input columns named like these outputs are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([*[(k, pa.int64()) for k in OUTPUTS[:-1]], (OUTPUTS[-1], pa.float64())])

    @F.arrow_udf(RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        (w, slope, offset), hasher = shared.value, Hasher()
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True

        def per_text(values, t):
            total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
            return total[np.maximum(t.end, t.begin)] - total[t.begin]

        def one(part: list[bytes]) -> list:
            t = Texts(part)
            n = len(part)
            sums = hasher.sums(t.data)
            words, of_words, doc_words, of_bytes = grams(t, hasher, sums)
            lead = (t.data & 0xC0) != 0x80
            # lines: equal ones of a text share a hash
            stop = np.flatnonzero(t.data == 10)
            start = np.concatenate([[0], stop[:-1] + 1])
            with_word = np.searchsorted(t.start, start) < np.searchsorted(t.start, stop)
            start, stop = start[with_word], stop[with_word]
            doc = np.searchsorted(t.end, start)
            line = mixed(hasher.ranges(sums, start, stop) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            n_dup = np.bincount(doc, minlength=n) - np.bincount(doc[np.unique(line, return_index=True)[1]], minlength=n)
            # windows of three words
            three = np.flatnonzero(t.doc[:-2] == t.doc[2:]) if len(t.doc) > 2 else np.empty(0, np.int64)
            key = mixed(words[three] + np.uint64(3) * mixed(words[three + 1] + np.uint64(5) * mixed(words[three + 2])) + t.doc[three].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            order = np.argsort(key)
            k = key[order]
            same = k[1:] == k[:-1]
            twice = three[order[np.append(same, False) | np.append(False, same)]] if len(k) else three
            again = np.zeros(len(t.doc), bool)
            for i in range(3):
                again[twice + i] = True
            # score: mean weight over both feature spaces
            z_words = np.bincount(doc_words, w[of_words], n) / np.maximum(np.bincount(doc_words, minlength=n), 1)
            four = w[of_bytes + (1 << BITS)] if len(of_bytes) else np.empty(0, np.float32)
            total = np.concatenate([[0], np.cumsum(four, dtype=np.float64)])
            n_four = np.maximum(t.end - t.begin - 3, 0)
            z_bytes = (total[np.minimum(t.begin + n_four, len(four))] - total[np.minimum(t.begin, len(four))]) / np.maximum(n_four, 1)
            p = 1 / (1 + np.exp(-np.clip(slope * (z_words + z_bytes) + offset, -700, 700)))
            return [t.n_words, per_text(lead & ~t.gap, t).astype(np.int64), per_text(symbol[t.data], t).astype(np.int64), n_dup, np.bincount(t.doc[again], minlength=n), p]

        for batch in batches:
            got = [one(part) for _, part in slices(batch.to_pylist())]
            columns = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.empty(0)] * len(OUTPUTS)
            yield pa.StructArray.from_arrays([pa.array(c.astype(np.float64 if k == OUTPUTS[-1] else np.int64)) for c, k in zip(columns, OUTPUTS, strict=True)], fields=list(kind))

    docs = dropped(docs, OUTPUTS)
    name = free_name(docs, "_q")
    return docs.withColumn(name, score(F.col(text_col))).select(*docs.columns, f"{name}.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str, *, max_train_rows: int = 3000, threshold: float = 0.3) -> DataFrame:
    """Every document; the model learns from at most ``max_train_rows`` labelled rows, never from held-out ones."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), id_col="doc_id", label_col="quality", max_rows=max_train_rows))
    judged = quality_rules(docs.select("doc_id", "text"), model)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *OUTPUTS[:-1], failed.alias("base_failed"), (~failed & (F.col("quality_score") >= threshold)).alias("kept"), "quality_score")
