"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids is linked."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.storage import discard
from sessionloom.llm.common import dropped, released, table, written

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
OUTPUTS = [*COUNTS, "n_best", "count_sum", "groups_sha256", "groups"]
#: Bytes of text in a block (one text at least): what a task holds at a time.
BLOCK_BYTES = 6 << 20
#: Chunks that are encoded in one call.
TOGETHER = 500
#: Fixed value: how the byte-level pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def leaf_groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """The groups (a from, a to, b from, b to) between neighbouring bytes where tokens of both end.

    Both lists ascend and have the same last entry.  Divide and conquer: from the
    middle of an interval's untested ends outwards, each end of A is looked up in B
    by bisect; at the first that both share the interval is cut, and both halves are
    done alike.  An interval without such a cut is a group.  The ends tested on the
    way lie at the cut, so either half starts without them: each is tested once.
    """
    out, todo = [], [(0, len(ends_a), 0, len(ends_b), 0, len(ends_a) - 2)]
    while todo:
        a0, a1, b0, b1, lo, hi = todo.pop()
        left = right = (lo + hi) // 2
        right += 1
        cut = None
        while cut is None and (left >= lo or right <= hi):
            for k in (left, right):
                if lo <= k <= hi:
                    j = bisect_left(ends_b, ends_a[k], b0, b1)
                    if j < b1 and ends_b[j] == ends_a[k]:
                        cut = k, j
                        break
            else:
                left, right = left - 1, right + 1
        if cut is None:
            out.append((a0, a1, b0, b1))
            continue
        k, j = cut
        after = right if k == left else right + 1  # the first untested end behind the cut
        before = left - 1  # and the last before it
        todo.append((k + 1, a1, j + 1, b1, max(after, k + 1), hi))
        todo.append((a0, k + 1, b0, j + 1, lo, min(before, k - 1)))
    return out


def all_leaf_groups(ends_a, ends_b, a0, b0, most: int = 64):
    """``leaf_groups`` of many intervals at once: all open ones look up their next two ends in each round.

    ``a0``, ``b0``: where the intervals begin, and the last ends; every begin is a shared
    cut.  Returns the groups' begins in A and in B, in order.  An interval still open
    after ``most`` rounds is left to ``leaf_groups``.
    """
    import numpy as np

    now = np.stack([a0[:-1], a0[1:], b0[:-1], b0[1:], a0[:-1], a0[1:] - 2])  # a from, a to, b from, b to, untested from, to
    left, right = (now[4] + now[5]) // 2, (now[4] + now[5]) // 2 + 1
    age, done = np.zeros(now.shape[1], np.int64), []
    while now.shape[1]:
        closed = (left < now[4]) & (right > now[5]) | (now[0] + 1 >= now[1]) | (now[2] + 1 >= now[3])
        done.append(now[:, closed][[0, 2]])
        for a, z, b, y, *_ in now[:, ~closed & (age >= most)].T.tolist():
            own = leaf_groups(ends_a[a:z].tolist(), ends_b[b:y].tolist())
            done.append(np.array([[a + g[0] for g in own], [b + g[2] for g in own]]))
        go = ~closed & (age < most)
        now, left, right, age = now[:, go], left[go], right[go], age[go] + 1
        cut, at = np.full(len(left), -1), np.zeros(len(left), np.int64)
        for k, some in ((right, right <= now[5]), (left, left >= now[4])):
            want = ends_a[np.where(some, k, 0)]
            j = np.searchsorted(ends_b, want)
            hit = some & (ends_b[j] == want)
            cut, at = np.where(hit, k, cut), np.where(hit, j, at)
        hit = cut >= 0
        k, j, old = cut[hit], at[hit], now[:, hit]
        first = np.stack([old[0], k + 1, old[2], j + 1, old[4], np.minimum(left[hit] - 1, k - 1)])
        second = np.stack([k + 1, old[1], j + 1, old[3], np.maximum(np.where(k == left[hit], right[hit], right[hit] + 1), k + 1), old[5]])
        new = np.concatenate([first, second], axis=1)
        now = np.concatenate([now[:, ~hit], new], axis=1)
        middle = (new[4] + new[5]) // 2
        left, right = np.concatenate([left[~hit] - 1, middle]), np.concatenate([right[~hit] + 1, middle + 1])
        age = np.concatenate([age[~hit], np.zeros(new.shape[1], np.int64)])
    begins = np.concatenate([np.zeros((2, 0), np.int64), *done], axis=1)
    return begins[:, np.argsort(begins[0])]


DOUBLE = re.compile(r" \s|\s ")


def chunks_of(text: str) -> list[str]:
    """``text`` cut at each single space between two characters that are not white space; the spaces go."""
    parts = text.split(" ")
    if len(parts) == 1 or text[0] != " " and text[-1] != " " and not DOUBLE.search(text):
        return parts
    out, run = [], [parts[0]]
    for before, p in zip(parts, parts[1:], strict=False):
        if before and p and not before[-1].isspace() and not p[0].isspace():
            out.append(" ".join(run))
            run = []
        run.append(p)
    out.append(" ".join(run))
    return out


class Chunks:
    """What is known of distinct chunks, as arrays: whether their bytes come back, tokens of A and B, groups, links, and pairs of ids."""

    def __init__(self, good, n_a, n_b, n_groups, said: list[bytes], pairs, n_links):
        self.good, self.n_a, self.n_b, self.n_groups, self.said, self.pairs, self.n_links = good, n_a, n_b, n_groups, said, pairs, n_links


class Pair:
    """A byte-level BPE (A) and a sentencepiece model (B).

    Neither joins across a single space between two other characters: A's
    pre-tokenizer begins a token there, and no piece of B has a space behind another
    character.  Such spaces are shared cuts of any text, known beforehand; the chunks
    between are aligned, each distinct one of a block once.  Where a tokenizer isn't of
    this kind, a whole text is one chunk.  A's vocabulary numbers its tokens in the
    order of their merges, so a rank encoder gives its ids; where it doesn't, its own
    encoder runs.
    """

    def __init__(self, path_a: str, path_b: str):
        import json

        import numpy as np
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path_a)
        self.full.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = [c for r in ("!~", "¡¬", "®ÿ") for c in range(ord(r[0]), ord(r[1]) + 1)]
        byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
        with open(path_a, encoding="utf-8") as f:
            kind = json.load(f)
        special = {t["id"] for t in kind.get("added_tokens", [])}
        self.bytes_a = {i: bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode() for w, i in self.full.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.width = len(pieces)
        before = kind.get("pre_tokenizer") or {}
        bytewise = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not kind.get("normalizer")
        self.cuts = bytewise and not any("▁" in p.lstrip("▁") for p in pieces)
        merges = [m.split(" ") if isinstance(m, str) else m for m in kind["model"]["merges"]]
        order = [kind["model"]["vocab"]["".join(m)] for m in merges]
        self.ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={x: i for i, x in self.bytes_a.items() if i not in special}, special_tokens={}) if bytewise and order == sorted(order) else None
        self.size_a, self.size_b = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = (pa.array([str(i) for i in range(len(x))], pa.string()) for x in (self.size_a, self.size_b))

    def chunks(self, text: str) -> list[str]:
        return chunks_of(text) if self.cuts else [text]

    def encoded(self, text: str):
        """(ids of A, ids of B) of a text to which B adds a space itself."""
        import numpy as np

        a = self.ranks.encode_ordinary(" " + text) if self.ranks else self.full.encode(" " + text, add_special_tokens=False).ids
        return np.array(a, np.int64), np.array(self.b.encode(text), np.int64)

    def same(self, text: str, a, b) -> bool:
        whole = text.encode()
        return all(b"".join(map(of.__getitem__, ids.tolist())) == whole for ids, of in ((a, self.bytes_a), (b, self.bytes_b)))

    def runs(self, chunks: list[str]) -> Iterator[list[str]]:
        """Chunks that can be encoded in one call: white space at a chunk's end, as at a text's, would join with the next space."""
        run: list[str] = []
        for c in chunks:
            odd = not self.cuts or not c or c[0].isspace() or c[-1].isspace()
            if run and (odd or len(run) == TOGETHER):
                yield run
                run = []
            if odd:
                yield [c]
            else:
                run.append(c)
        if run:
            yield run

    def aligned(self, chunks: list[str]) -> Chunks:
        import numpy as np

        parts_a, parts_b, good = [], [], np.ones(len(chunks), bool)
        at = 0
        for part in self.runs(chunks):
            a, b = self.encoded(" ".join(part))
            if not self.same("".join(" " + c for c in part), a, b):
                each = [self.encoded(c) for c in part]
                for k, (c, (x, y)) in enumerate(zip(part, each, strict=True)):
                    good[at + k] = self.same(" " + c, x, y)
                kept = [e for k, e in enumerate(each) if good[at + k]]
                a, b = (np.concatenate([np.zeros(0, np.int64), *(e[k] for e in kept)]) for k in (0, 1))
            parts_a.append(a)
            parts_b.append(b)
            at += len(part)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (parts_a, parts_b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        size = np.array([len(c.encode()) + 1 for c in chunks], np.int64) * good
        edges = np.concatenate([[0], np.cumsum(size[good])])  # the good chunks lie end to end
        at_a, at_b = (np.concatenate([[0], np.searchsorted(e, edges[1:]) + 1]) for e in (ends_a, ends_b))
        if not len(a):
            none = np.zeros(len(chunks), np.int64)
            return Chunks(good, none, none, none, [b""] * len(chunks), np.zeros(0, np.int64), none)
        begin_a, begin_b = all_leaf_groups(ends_a, ends_b, at_a, at_b)
        groups = np.searchsorted(begin_a, at_a)
        ends_of = np.append(begin_a, len(a)), np.append(begin_b, len(b))

        def joined(lo: int, hi: int) -> pa.Array:
            """The groups lo to hi as text."""
            sides = []
            for names, ids, e in ((self.name_a, a, ends_of[0]), (self.name_b, b, ends_of[1])):
                own = names.take(pa.array(ids[e[lo] : e[hi]]))
                sides.append(pc.binary_join(pa.ListArray.from_arrays((e[lo : hi + 1] - e[lo]).astype(np.int32), own), ","))
            return pc.binary_join_element_wise(*sides, "|")

        said: list[str] = []
        for lo in range(0, len(groups) - 1, 200_000):  # chunks
            hi = min(lo + 200_000, len(groups) - 1)
            said += pc.binary_join(pa.ListArray.from_arrays((groups[lo : hi + 1] - groups[lo]).astype(np.int32), joined(groups[lo], groups[hi])), ";").to_pylist()
        # tokens that overlap meet in one stretch between neighbouring ends of either
        stretch = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two runs in order
        stretch = stretch[np.append(True, np.diff(stretch) > 0)]
        pairs = a[np.searchsorted(ends_a, stretch)] * self.width + b[np.searchsorted(ends_b, stretch)]
        links = np.searchsorted(stretch, edges, "right")
        spread = lambda x: np.bincount(np.flatnonzero(good), np.diff(x), len(chunks)).astype(np.int64)
        texts = iter(said)
        return Chunks(good, spread(at_a), spread(at_b), spread(groups), [next(texts).encode() if g else b"" for g in good.tolist()], pairs, spread(links))


def token_alignment(docs: DataFrame, *, path_a: str, path_b: str, text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """Each document's tokens under two tokenizers, cut into groups where tokens of both end.

    ``path_a``: a byte-level BPE of ``tokenizers``, which encodes a space and the
    text; ``path_b``: a model of ``sentencepiece``, which adds that space itself.
    Returns the input's columns but the text, and long n_a, n_b (tokens), n_groups,
    n_links (pairs of an A and a B token whose bytes overlap), n_best (links whose
    pair of ids is linked as often in the corpus as any with that B id, ties
    included), count_sum (over links, how often their pair of ids is linked in the
    corpus), groups_sha256 and, ``with_groups``, groups (``a1,a2|b1;a3|b2,b3``).
    Null and empty texts, and those whose tokens' bytes differ from the text's, have
    zeros and empty strings and count nowhere.  Repeated rows count each.  Input
    columns named like the outputs are replaced.

    A task reads texts in blocks of BLOCK_BYTES and writes, of each block, its linked
    pairs with their numbers and the documents as lists of chunks.  The pairs are
    added up over all blocks, and each block gets the sums of its own pairs back, so
    nothing of the corpus's size is broadcast or held by one task.
    """
    spark = docs.sparkSession
    docs = dropped(docs, OUTPUTS)
    rest = [c for c in docs.columns if c != text_col]
    names = [f"_c{i}" for i in range(len(rest))]
    source = docs.select(F.struct(F.lit(True).alias("_some"), *[F.col(c).alias(n) for c, n in zip(rest, names, strict=True)]).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    row = source.schema["_row"].dataType.simpleString()
    schema = f"_block long, _row {row}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, _ids binary, _pairs array<long>, _ns array<long>, _flat binary, _cuts binary"
    plain = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def packed(x) -> bytes:
        return len(x).to_bytes(8, "little") + pa.compress(x.astype("<u4").tobytes(), codec="zstd", asbytes=True) if len(x) else b""

    def unpacked(b: bytes):
        import numpy as np

        return np.frombuffer(pa.decompress(b[8:], decompressed_size=4 * int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True) if b else b"", "<u4").astype(np.int64)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        pair, block, rows, texts, size, row_type = None, TaskContext.get().partitionId() << 33, [], [], 0, None

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal block, rows, texts, size
            at: dict[str, int] = {}
            each = [np.array([at.setdefault(c, len(at)) for c in pair.chunks(t)] if t else [], np.int64) for t in texts]
            found, out = pair.aligned(list(at)), []
            whole = [len(ids) > 0 and bool(found.good[ids].all()) for ids in each]
            uses = np.bincount(np.concatenate([np.zeros(0, np.int64), *(ids for ids, ok in zip(each, whole, strict=True) if ok)]), minlength=len(at))
            for r, ids, ok in zip(rows, each, whole, strict=True):
                if not ok:
                    out.append((block, r, 0, 0, 0, 0, "", "", b"", None, None, None, None))
                    continue
                said = b";".join([found.said[i] for i in ids.tolist()])
                out.append((block, r, *(int(n[ids].sum()) for n in (found.n_a, found.n_b, found.n_groups, found.n_links)), hashlib.sha256(said).hexdigest(), said.decode() if with_groups else None, packed(ids), None, None, None, None))
            keys, flat = np.unique(found.pairs, return_inverse=True)
            ns = np.bincount(flat, np.repeat(uses, found.n_links), minlength=len(keys)).astype(np.int64)
            out.append((block, None, *[None] * 7, keys.tolist(), ns.tolist(), packed(flat), packed(np.concatenate([[0], np.cumsum(found.n_links)]))))
            kinds = [pa.int64(), row_type, *plain]
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000], strict=True), kinds, strict=True)], names=schema_names)
            block, rows, texts, size = block + 1, [], [], 0

        for batch in batches:
            pair = pair or Pair(path_a, path_b)
            row_type = batch.schema.field("_row").type
            for r, t in zip(batch.column("_row"), batch.column("_text"), strict=True):
                t = t.as_py() or ""
                if rows and size + len(t) > BLOCK_BYTES:
                    yield from done()
                    released()
                rows.append(r.as_py())
                texts.append(t)
                size += len(t)
        if rows:
            yield from done()
        del pair
        released()

    schema_names = ["_block", "_row", *COUNTS, "groups_sha256", "groups", "_ids", "_pairs", "_ns", "_flat", "_cuts"]
    blocks = written(source.mapInArrow(align, schema), "aligned")
    pairs = blocks.filter("_pairs is not null").select("_block", F.posexplode(F.arrays_zip("_pairs", "_ns"))).select("_block", F.col("pos").alias("_at"), F.col("col._pairs").alias("_pair"), F.col("col._ns").alias("_n")).filter("_n > 0")
    width = pieces_of(path_b)
    totals = pairs.groupBy("_pair").agg(F.sum("_n").alias("_total"))
    most = totals.groupBy((F.col("_pair") % width).alias("_b")).agg(F.max("_total").alias("_most"))
    best = F.broadcast(most)  # a row for each piece of B at most
    totals = totals.join(best, F.col("_pair") % width == F.col("_b")).select("_pair", "_total", (F.col("_total") == F.col("_most")).alias("_best"))
    known = written(pairs.join(totals, "_pair").select("_block", "_at", "_total", "_best"), "pair-totals")
    out_schema = f"_row {row}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"

    def scored(mine: pa.Table, sums: pa.Table) -> pa.Table:
        """Of one block: the documents, each with the sums over its chunks."""
        import numpy as np
        import pyarrow.compute as pc

        is_doc = pc.is_valid(mine.column("_row"))
        head, rows = mine.filter(pc.invert(is_doc)).to_pylist()[0], mine.filter(is_doc)
        n = len(head["_pairs"])
        total, is_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = sums.column("_at").to_numpy()
        total[at] = sums.column("_total").to_numpy()
        is_best[at] = sums.column("_best").to_numpy()
        flat, cuts = unpacked(head["_flat"]), unpacked(head["_cuts"])
        by_chunk = []
        for x in (is_best, total):
            run = np.concatenate([[0], np.cumsum(x[flat])])
            by_chunk.append(run[cuts[1:]] - run[cuts[:-1]])
        ids = [unpacked(b) for b in rows.column("_ids").to_pylist()]
        best, count = ([int(x[i].sum()) for i in ids] for x in by_chunk)
        return pa.Table.from_arrays([rows.column("_row"), *[rows.column(c) for c in COUNTS], pa.array(best, pa.int64()), pa.array(count, pa.int64()), rows.column("groups_sha256"), rows.column("groups")], names=["_row", *COUNTS, "n_best", "count_sum", "groups_sha256", "groups"])

    out = written(blocks.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(scored, out_schema), "token-alignment")
    discard(blocks, known)
    return out.select(*[F.col("_row")[n].alias(c) for c, n in zip(rest, names, strict=True)], *(OUTPUTS if with_groups else OUTPUTS[:-1]))


def pieces_of(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a byte-level BPE and a piece model."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = token_alignment(docs, path_a=public_tokenizers.path("byte_bpe_50k.json"), path_b=public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
