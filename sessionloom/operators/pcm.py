"""Stored PCM: frames with energy scores, clips, model seams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME_SAMPLES = 512
HEADER = 44


def laid_out(segments: DataFrame) -> DataFrame:
    """Segments (session_id, sequence, content with its header) with the byte offset of their data in the session.

    An odd last byte is no sample: neither the size nor the offset counts it.
    """
    w = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    size = F.expr(f"bigint(greatest(length(content) - {HEADER}, 0) div 2 * 2)")
    return segments.withColumn("data_bytes", size).withColumn("offset", F.coalesce(F.sum("data_bytes").over(w), F.lit(0)).cast("long"))


def energy_frames(segments: DataFrame, *, min_rms: float = 500.0) -> DataFrame:
    """(session_id, frame, rms, p): 512-sample frames across segment seams; p is 1 at ``min_rms`` or more, else 0.

    Each task sums squares per frame it has part of; Spark adds the parts of frames
    that lie over a seam.  A last frame that is not full is left out.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for session, offset, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(content[HEADER : HEADER + (len(content) - HEADER) // 2 * 2], "<i2").astype(np.float64)
                if len(x):
                    frame = (offset // 2 + np.arange(len(x))) // FRAME_SAMPLES
                    first = np.flatnonzero(np.diff(frame, prepend=-1))
                    yield pa.RecordBatch.from_arrays([pa.array([session] * len(first), batch.schema.field(0).type), pa.array(frame[first]), pa.array(np.add.reduceat(x * x, first)), pa.array(np.diff(np.append(first, len(x))))], names=["session_id", "frame", "squares", "n"])

    rows = laid_out(segments).filter("data_bytes > 0").select("session_id", "offset", "content")
    kind = segments.schema["session_id"].dataType.simpleString()
    f = rows.mapInArrow(parts, f"session_id {kind}, frame long, squares double, n long").groupBy("session_id", "frame").agg(F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    f = f.filter(F.col("n") == FRAME_SAMPLES).withColumn("rms", F.sqrt(F.col("squares") / F.col("n")))
    return f.select("session_id", "frame", "rms", (F.col("rms") >= min_rms).cast("double").alias("p"))


def clips(segments: DataFrame, wanted: DataFrame, *, rate: int = 16_000, channels: int = 1) -> DataFrame:
    """(session_id, clip_id, pcm): the bytes of each wanted [start_ms, end_ms), over as many segments as it takes."""
    per_ms = rate * channels * 2 / 1000
    width = channels * 2
    lo, hi = (F.floor(F.col(c) * per_ms / width) * width for c in ("start_ms", "end_ms"))
    w = wanted.select("session_id", "clip_id", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    s = laid_out(segments).filter("data_bytes > 0")
    j = s.join(w, "session_id").filter("offset < hi and offset + data_bytes > lo")
    part = F.expr(f"substring(content, {HEADER} + int(greatest(lo - offset, 0)) + 1, int(least(hi - offset, data_bytes) - greatest(lo - offset, 0)))")
    g = j.groupBy("session_id", "clip_id").agg(F.array_sort(F.collect_list(F.struct("sequence", part.alias("b")))).alias("parts"))
    return g.select("session_id", "clip_id", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["b"])).alias("pcm"))


def scored(df: DataFrame, setup: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """A model over batches: ``setup`` loads it once a task and returns what maps a batch to a batch of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = setup()
        for batch in batches:
            yield model(batch)

    return df.mapInArrow(run, schema)


def checked_vectors(df: DataFrame, column: str, *, strict: bool) -> DataFrame:
    """Vectors that are not finite: their rows go (strict) or they become null."""
    ok = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(ok) if strict else df.withColumn(column, F.when(ok, F.col(column)))
