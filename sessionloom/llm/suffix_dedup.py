"""Repeated byte strings across documents, removed by a sparse suffix array built in range partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import table, written
from sessionloom.llm.textvec import Hasher, mixed

GRAM = 24  # bytes: the leading token of a suffix
LAST = (1 << 63) - 1  # stands for a null id: after all others


class Suffixes:
    """The suffixes of a block of texts at its anchors.

    Of each string of ``length`` bytes the anchor is its 24-byte gram of least hash
    (the first of equals), so equal strings have equal anchors at equal places.  The
    strings that share an anchor make one run: their starts are ``start`` to ``start
    + n - 1``, and ``context`` are the bytes that they cover together.
    """

    def __init__(self, raw: bytes, sizes, length: int, hasher: Hasher):
        import numpy as np

        self.data = np.frombuffer(raw, np.uint8)
        self.length, self.hasher = length, hasher
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.sums = hasher.sums(self.data)
        n = len(self.data)
        here = np.arange(max(n - GRAM + 1, 0))
        gram = hasher.ranges(self.sums, here, here + GRAM)
        bits = max(n, 2).bit_length()
        low = (gram >> np.uint64(bits) << np.uint64(bits)) | here.astype(np.uint64)
        span, reach = length - GRAM + 1, 1
        while 2 * reach <= span:
            low = np.minimum(low[: len(low) - reach], low[reach:]) if len(low) > reach else low[:0]
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :]) if len(low) > span - reach else low[:0]
        anchor = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
        whole = np.zeros(n + 1, np.int32)  # strings that lie in one document
        fits = sizes >= length
        np.add.at(whole, self.begins[fits], 1)
        np.add.at(whole, self.ends[fits] - length + 1, -1)
        inside = np.cumsum(whole[: len(anchor)]) > 0
        at = np.flatnonzero(inside)
        a = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(a) != 0)
        first = np.flatnonzero(new)
        self.start, self.anchor = at[first], a[first]
        self.n = np.diff(np.append(first, len(at)))
        # two documents that touch never share a run: their strings start apart by `length` - 1 at least
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.key = gram[self.anchor]
        del gram, low, here, inside, at, a, whole, anchor

    def leads(self):
        """The first eight bytes of each suffix as a number that sorts like them."""
        import numpy as np

        out = np.zeros(len(self.anchor), np.uint64)
        for i in range(8):
            out = out << np.uint64(8) | self.data[self.anchor + i].astype(np.uint64)
        return out

    def contexts(self, of):
        """64-bit names of the contexts of runs ``of`` and of the anchors' places in them."""
        import numpy as np

        h = self.hasher.ranges(self.sums, self.start[of], self.start[of] + self.n[of] + self.length - 1)
        return mixed(h ^ mixed(self.key[of] + (self.anchor[of] - self.start[of]).astype(np.uint64)))


def runs_of(*keys):
    """(order, where runs of equal keys begin): multikey quicksort, later keys only where the earlier ones tie."""
    import numpy as np

    order = np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[0][order][1:] != keys[0][order][:-1]
    for key in keys[1:]:
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        run = np.cumsum(new)[tied]
        sub = order[tied]
        sub = sub[np.lexsort((key[sub], run))]
        order[tied] = sub
        k = key[sub]
        new[tied[1:]] |= (np.diff(run) == 0) & (k[1:] != k[:-1])
    return order, np.flatnonzero(new)


def bucket_of(lead, key, splitters):
    """Range partition by leading bytes; among equal splitters by the whole leading token."""
    import numpy as np

    lo, hi = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
    return lo + (key % (hi - lo + 1).astype(np.uint64)).astype(np.int64)


def rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time: only one block's bytes are copied."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def repeats_removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = 1 << 20, bucket_bytes: int = 2 << 20) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): each text without what a document of smaller id has too.

    Texts are UTF-8 bytes.  A byte goes if it lies in a string of ``length`` bytes
    that also starts in a document with a smaller id; judged on the input.  ``spans``
    are the maximal removed byte ranges, ``kept`` the other bytes in order.  Ids are
    integers; a null id counts as larger than all others and stays null; rows with
    equal ids do not remove each other's bytes.  Null and empty texts: no bytes.

    Suffixes are taken at anchors, which every string of ``length`` bytes has in it.
    Sampled splitters range-partition them by their leading bytes.  First only the
    leading tokens travel, 32 bits of each once a block of texts; buckets sort them and
    answer with a bit for each whether several documents have it (tokens alike in
    these bits count as one: more is sent then, never less).  Then the contexts of just
    those travel, named anew where they arrive; buckets sort them by multikey
    quicksort and compare.  A token lies in one bucket, and a
    block sends it once however often it has it, so no bucket holds a frequent
    passage more than once a block.
    """
    import numpy as np

    spark = docs.sparkSession

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def block():
            return pa.RecordBatch.from_pylist([{"block": number, "ids": np.array(ids, np.int64).tobytes(), "nulls": bytes(i == LAST for i in ids), "sizes": np.array([len(t) for t in texts], np.int64).tobytes(), "text": zstandard.ZstdCompressor(level=9).compress(b"".join(texts)), "n_bytes": size}], pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), *[(c, pa.binary()) for c in ("ids", "nulls", "sizes", "text")]]))

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = (t.as_py() or "").encode()
                if texts and size + len(b) > block_bytes:
                    yield block()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(LAST if i is None else i)
                texts.append(b)
                size += len(b)
        if texts:
            yield block()

    def opened(row: dict, hasher: Hasher) -> tuple[Suffixes, np.ndarray]:
        import zstandard

        row["text"] = zstandard.ZstdDecompressor().decompress(row["text"])
        return Suffixes(row["text"], np.frombuffer(row["sizes"], np.int64), length, hasher), np.frombuffer(row["ids"], np.int64)

    blocks = written(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(to_blocks, "block long, n_bytes long, ids binary, nulls binary, sizes binary, text binary"), "blocks")
    n_bytes, n_blocks = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    n_buckets = max(16, int(n_bytes * 16 // (length - GRAM + 2) // bucket_bytes))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for row in rows(batch):
                s, _ = opened(row, hasher)
                yield pa.RecordBatch.from_arrays([pa.array(s.leads()[:: max(1, len(s.anchor) // 2000)].view(np.int64))], names=["lead"])

    # a bounded sample decides where buckets begin, never what is in the result
    leads = blocks.orderBy(F.xxhash64("block")).limit(32).mapInArrow(sample, "lead long").limit(80_000).collect() if n_blocks else []
    leads = np.sort(np.array([r[0] for r in leads], np.int64).view(np.uint64))
    splitters = leads[(np.arange(1, n_buckets) * len(leads)) // n_buckets] if len(leads) else np.empty(0, np.uint64)
    shared = spark.sparkContext.broadcast(splitters)

    def parts_of(s: Suffixes):
        """(order, where each key's runs begin in it, the buckets, which keys go to each): the same whenever it is asked."""
        order, first = runs_of(s.key)
        one = order[first]
        where = bucket_of(s.leads()[one], s.key[one], shared.value)
        by = np.argsort(where, kind="stable")
        cut = np.flatnonzero(np.diff(where[by], prepend=-1))
        return order, first, where[by][cut].tolist(), [by[a:b] for a, b in zip(cut, np.append(cut[1:], len(by)), strict=True)]

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for row in rows(batch):
                s, ids = opened(row, hasher)
                if not len(s.key):
                    continue
                order, first, where, parts = parts_of(s)
                doc = ids[s.doc[order]]
                # a key that several documents of the block have is shared whatever the other blocks say
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                short = (s.key[order[first]] >> np.uint64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([row["block"]] * len(parts), pa.int64()), pa.array([short[p].tobytes() for p in parts], pa.binary()), pa.array([np.packbits(several[p]).tobytes() for p in parts], pa.binary())], names=["bucket", "block", "keys", "several"])

    def shared_keys(t: pa.Table) -> pa.Table:
        blocks_, keys = t.column("block").to_pylist(), [np.frombuffer(b, "<u4") for b in t.column("keys").to_pylist()]
        several = [np.unpackbits(np.frombuffer(b, np.uint8))[: len(k)] for b, k in zip(t.column("several").to_pylist(), keys, strict=True)]
        key, of = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order, first = runs_of(key)
        size = np.diff(np.append(first, len(order)))
        yes = (size > 1) | np.maximum.reduceat(np.concatenate(several)[order], first).astype(bool)
        bits = np.empty(len(key), bool)
        bits[order] = np.repeat(yes, size)
        cut = np.searchsorted(of, np.arange(len(keys) + 1))
        return pa.table({"block": pa.array(blocks_, pa.int64()), "bucket": t.column("bucket"), "reply": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    keys = blocks.mapInArrow(send_keys, "bucket int, block long, keys binary, several binary")
    replies = written(keys.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(shared_keys, "block long, bucket int, reply binary"), "shared-keys")

    def answered(replies: DataFrame) -> DataFrame:
        return blocks.join(replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies")), "block", "left")

    def chosen(s: Suffixes, replies: list) -> np.ndarray:
        """Runs whose key the buckets have found to be shared."""
        bits = {r["bucket"]: r["reply"] for r in replies}
        if not bits:
            return np.empty(0, np.int64)
        order, first, where, parts = parts_of(s)
        yes = np.zeros(len(first), bool)
        for b, p in zip(where, parts, strict=True):
            yes[p] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(p))
        return np.sort(order[np.repeat(yes, np.diff(np.append(first, len(order))))])

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hasher, shrink = Hasher(), zstandard.ZstdCompressor(level=9).compress
        for batch in batches:
            for row in rows(batch):
                s, ids = opened(row, hasher)
                run = chosen(s, row["replies"] or [])
                if not len(run):
                    continue
                name, doc = s.contexts(run), ids[s.doc[run]]
                order, first = runs_of(name)
                one, least = run[order[first]], np.minimum.reduceat(doc[order], first)
                where = bucket_of(s.leads()[one], s.key[one], shared.value)
                by = np.argsort(where, kind="stable")
                cut = np.flatnonzero(np.diff(where[by], prepend=-1))
                out = []
                for p in (by[a:b] for a, b in zip(cut, np.append(cut[1:], len(by)), strict=True)):
                    r = one[p]
                    size = s.n[r] + length - 1
                    text = s.data[np.repeat(s.start[r] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    out.append({"bucket": int(where[p[0]]), "block": row["block"], "docs": shrink(least[p].tobytes()), "shape": np.stack([s.anchor[r] - s.start[r], s.n[r]]).astype(np.uint8).tobytes(), "text": shrink(text.tobytes())})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("docs", "shape", "text")]]))

    def compare(t: pa.Table) -> pa.Table:
        """For each block's contexts: the least document that has it, and which of its strings a still smaller one has; left out where the block knows as much."""
        import zstandard

        opened_ = lambda c, kind: np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, t.column(c).to_pylist())), kind)
        doc, data = opened_("docs", np.int64), opened_("text", np.uint8)
        each = np.array([len(b) // 2 for b in t.column("shape").to_pylist()])
        shape = np.concatenate([np.frombuffer(b, np.uint8).reshape(2, -1) for b in t.column("shape").to_pylist()], 1).astype(np.int64)
        place, n = shape
        size = n + length - 1
        start = np.cumsum(size) - size
        one, two = Hasher(), Hasher()
        two.codes = two.codes[::-1].copy()
        sums, sums2 = one.sums(data), two.sums(data)
        key = one.ranges(sums, start + place, start + place + GRAM)
        name = mixed(one.ranges(sums, start, start + size) ^ mixed(key + place.astype(np.uint64)))
        # equal contexts
        order, first = runs_of(key, name, two.ranges(sums2, start, start + size))
        least = np.minimum.reduceat(doc[order], first)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        rep = order[first]
        # their strings, where a key has several contexts
        new = np.append(True, key[rep][1:] != key[rep][:-1])
        many = ~new | np.append(~new[1:], False)
        g = np.flatnonzero(many)
        r = rep[g]
        m = n[r]
        which = np.repeat(np.arange(len(g)), m)
        i = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
        at = start[r][which] + i
        anchor_at = (i - place[r][which] + 256).astype(np.uint64)
        w1 = mixed(one.ranges(sums, at, at + length) ^ mixed(key[r][which] + anchor_at))
        w2 = two.ranges(sums2, at, at + length)
        mask = np.zeros(len(first), np.uint64)
        if len(which):
            o, f = runs_of(w1, w2)
            d = least[g][which]
            low = np.empty(len(o), np.int64)
            low[o] = np.repeat(np.minimum.reduceat(d[o], f), np.diff(np.append(f, len(o))))
            np.bitwise_or.at(mask, g[which], np.where(low < d, np.uint64(1) << i.astype(np.uint64), np.uint64(0)))
        matters = (mask[group] != 0) | (least[group] < doc)
        out, at, shrink = [], 0, zstandard.ZstdCompressor(level=1).compress
        for k in each:
            own = np.arange(at, at + k)[matters[at : at + k]]
            out.append(shrink(np.stack([name[own], least[group[own]].view(np.uint64), mask[group[own]]]).tobytes()))
            at += k
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "reply": pa.array(out, pa.binary())})

    contexts = answered(replies).mapInArrow(send_contexts, "bucket int, block long, docs binary, shape binary, text binary")
    judged = written(contexts.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(compare, "block long, bucket int, reply binary"), "compared")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hasher, unpack = Hasher(), zstandard.ZstdDecompressor().decompress
        kind = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
        for batch in batches:
            for row in rows(batch):
                s, ids = opened(row, hasher)
                parts = [np.frombuffer(unpack(r["reply"]), np.uint64).reshape(3, -1) for r in row["replies"] or []]
                name, least, mask = np.concatenate([np.empty((3, 0), np.uint64), *parts], 1)
                depth = np.zeros(len(s.data) + length + 1, np.int32)
                run_name, own = s.contexts(np.arange(len(s.start))), ids[s.doc]
                order, first = runs_of(run_name)
                before = np.zeros(len(own), bool)
                if len(first):  # within the block
                    before[order] = np.repeat(np.minimum.reduceat(own[order], first), np.diff(np.append(first, len(order)))) < own[order]
                hit = np.empty(0, np.int64)
                if len(name):
                    by = np.argsort(name)
                    at = np.minimum(np.searchsorted(name[by], run_name), len(by) - 1)
                    hit = np.flatnonzero(name[by][at] == run_name)
                    answer = by[at[hit]]
                    before[hit] |= least[answer].view(np.int64) < own[hit]
                full = np.flatnonzero(before)
                np.add.at(depth, s.start[full], 1)
                np.add.at(depth, s.start[full] + s.n[full] + length - 1, -1)
                if len(hit):
                    rest = ~before[hit]
                    part, bits = hit[rest], mask[answer[rest]]
                    for i in range(length - GRAM + 1):
                        p = s.start[part[(bits >> np.uint64(i)) & np.uint64(1) == 1]] + i
                        np.add.at(depth, p, 1)
                        np.add.at(depth, p + length, -1)
                gone = np.cumsum(depth[: len(s.data)]) > 0
                raw, out = row["text"], []
                for d, (a, b) in enumerate(zip(s.begins.tolist(), s.ends.tolist(), strict=True)):
                    g = gone[a:b]
                    if not g.any():
                        out.append((b - a, 0, [], raw[a:b]))
                        continue
                    edge = np.flatnonzero(np.diff(g.view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
                    out.append((b - a, int(g.sum()), [{"start": x, "end": y} for x, y in zip(edge[0::2], edge[1::2], strict=True)], s.data[a:b][~g].tobytes()))
                n, removed, spans, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([None if z else int(i) for i, z in zip(ids, row["nulls"], strict=True)], pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind.field("spans").type), pa.array(kept, pa.binary())], schema=kind)

    out = answered(judged).mapInArrow(cut, "id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


OP5_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM t WHERE len(h) >= 100),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS x FROM s),
m AS (SELECT x, min(doc_id) AS least FROM g GROUP BY x HAVING min(doc_id) < max(doc_id)),
q AS (SELECT doc_id, p FROM g JOIN m USING (x) WHERE least < doc_id),
b AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM q),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, run),
k AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM r),
o AS (SELECT k.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head, max(z) AS tail, CAST(sum(z - a) AS BIGINT) AS removed, count(*) AS spans FROM k JOIN t ON t.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT t.doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN o ON o.doc_id = t.doc_id
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that documents of smaller id have."""
    out = repeats_removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
