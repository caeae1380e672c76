"""Byte ranges of stored files, and clips cut from them without reading the files whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of content in a batch.
BATCH_BYTES = 4 << 20


def read_ranges(ranges: DataFrame, root: str, *, path_col: str = "path", offset_col: str = "offset", length_col: str = "length") -> DataFrame:
    """``ranges`` with ``content``: ``length`` bytes from ``offset`` on of the file ``path`` under ``root``.

    Each task reads its own ranges, those of a file one after another from one open
    handle, and nothing but the bytes asked for.  ``root`` is a folder or URI of a file
    system that Arrow knows (local, HDFS, S3, GCS).  A range that goes over the end of
    its file gives what there is; of a file that isn't there, a null path, offset or
    length, null.
    """
    kinds = ranges.schema
    out = ranges.sortWithinPartitions(path_col, offset_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        name, handle = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (path_col, offset_col, length_col)]
            content, begin, size = [], 0, 0
            for i, (path, offset, length) in enumerate(zip(*columns, strict=True), 1):
                got = None
                if path is not None and offset is not None and length is not None:
                    if path != name:
                        name = path
                        try:
                            handle = system.open_input_file(f"{base.rstrip('/')}/{path.lstrip('/')}")
                        except FileNotFoundError:
                            handle = None
                    if handle is not None:
                        end = handle.size()
                        got = handle.read_at(max(0, min(length, end - offset)), min(offset, end))
                content.append(got)
                size += len(got or b"")
                if size > BATCH_BYTES or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, i - begin).columns, pa.array(content, pa.binary())], names=[*batch.schema.names, "content"])
                    content, begin, size = [], i, 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
    return out.mapInArrow(read, f"{fields}, content binary")


def clip_ranges(segments: DataFrame, wanted: DataFrame, *, rate: int = 16_000, channels: int = 1, header: int = 44) -> DataFrame:
    """(session_id, clip_id, sequence, path, offset, length): where the bytes of each wanted [start_ms, end_ms) lie.

    segments: session_id, sequence, path, byte_size (with a header of ``header`` bytes).
    Only sizes are looked at; an odd last byte of a segment is no sample.
    """
    per_ms, width = rate * channels * 2 / 1000, channels * 2
    line = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    size = F.expr(f"bigint(greatest(byte_size - {header}, 0) div 2 * 2)")
    s = segments.select("session_id", "sequence", "path", size.alias("n")).withColumn("at", F.coalesce(F.sum("n").over(line), F.lit(0)))
    lo, hi = ((F.floor(F.col(c) * per_ms / width) * width).cast("long") for c in ("start_ms", "end_ms"))
    w = wanted.select("session_id", "clip_id", lo.alias("lo"), hi.alias("hi"))
    j = s.join(w, "session_id").filter("n > 0 and at < hi and at + n > lo")
    first = F.greatest(F.col("lo") - F.col("at"), F.lit(0))
    return j.select("session_id", "clip_id", "sequence", "path", (first + header).alias("offset"), (F.least(F.col("hi") - F.col("at"), "n") - first).alias("length"))


def clips_of_files(segments: DataFrame, wanted: DataFrame, root: str, **audio) -> DataFrame:
    """(session_id, clip_id, pcm) of each wanted clip, over as many files as it takes; only its own bytes are read."""
    parts = read_ranges(clip_ranges(segments, wanted, **audio), root)
    g = parts.groupBy("session_id", "clip_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "content"))).alias("parts"))
    return g.select("session_id", "clip_id", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["content"])).alias("pcm"))
