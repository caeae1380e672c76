"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.storage import written


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component; nodes 0 to n - 1, links a to b."""
    out = np.arange(n)
    while True:
        least = np.minimum(out[a], out[b])
        new = out.copy()
        np.minimum.at(new, out[a], least)
        np.minimum.at(new, out[b], least)
        while (new != new[new]).any():
            new = new[new]
        new = new[out]
        if (new == out).all():
            return out
        out = new


def components(links: DataFrame, *, most_links: int = 500_000) -> DataFrame:
    """(id, component): for every id in ``links`` (a, b) a name of its component, one of its ids.

    Each round first contracts what lies in one partition, ``most_links`` at a time,
    to stars; then the least root of each node names the others, and links between
    roots go on to the next round.  Least: by a hash of the round's own, so that a
    node all of whose neighbours are less is gone after it, and even chains and stars
    spread over many partitions shrink by a constant share.  Each round is written out.
    """
    kind = links.schema["a"].dataType.simpleString()

    def stars(batches: Iterator[pa.RecordBatch], round_no: int) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def contracted() -> pa.RecordBatch:
            both = pa.table(pa.Table.from_batches(held)).combine_chunks()
            coded = pa.concat_arrays([both.column(c).chunk(0) for c in ("a", "b")]).dictionary_encode()
            rank = pd.util.hash_array(np.asarray(coded.dictionary)) ^ np.uint64(round_no * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            rank = ((rank ^ rank >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)  # another order each round
            order = np.argsort(rank, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            codes = place[coded.indices.to_numpy()]
            root = order[labels(codes[: both.num_rows], codes[both.num_rows :], len(order))[place]]
            return pa.RecordBatch.from_arrays([coded.dictionary, coded.dictionary.take(pa.array(root)), pa.array(rank[root])], names=["id", "root", "rank"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= most_links:
                yield contracted()
                held, size = [], 0
        if held:
            yield contracted()

    edges, names, round_no = links.select("a", "b"), None, 0
    while True:
        found = written(edges.mapInArrow(lambda it, r=round_no: stars(it, r), f"id {kind}, root {kind}, rank long"), "stars")
        least = written(found.groupBy("id").agg(F.min(F.struct("rank", "root"))["root"].alias("component")), "least")
        names = least if names is None else names.withColumnRenamed("component", "_at").join(least.withColumnRenamed("id", "_at"), "_at", "left").select("id", F.coalesce("component", "_at").alias("component"))
        edges = found.join(least, "id").filter("root != component").select(F.col("root").alias("a"), F.col("component").alias("b")).distinct()
        edges = written(edges, "links")
        if not edges.limit(1).count():
            return written(names, "components") if round_no else names
        round_no += 1
