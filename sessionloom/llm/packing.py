"""Bounded-space online packing of tokenised documents into training windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import dropped, released, table, written

PIECES = "start long, length long, token_ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
OUTPUTS = ["start", "length", "token_ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
#: Bytes of text that a task encodes at a time, and of token ids in a batch that it hands on.
TEXT_BYTES, BATCH_BYTES = 2 << 20, 4 << 20


def gathered(flat, start, length):
    """The runs flat[start : start + length], one after another."""
    import numpy as np

    ends = np.cumsum(length)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((start - (ends - length)).astype(kind), length)
    at += np.arange(n, dtype=kind)
    return flat.take(at)


class Encoder:
    """Whole texts to token ids.

    The tokenizer drops white space, folds case and never joins across white space
    or between a letter and the punctuation after it.  So of a batch of texts each
    distinct chunk between spaces is encoded once, the punctuation that ends it
    apart from its word, and the ids are laid out by numpy.
    """

    SPLIT = r"^(?P<core>[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]*)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"  # letters, then ASCII punctuation but the apostrophe
    MARK = "\x1f"  # a token of its own between chunks that are encoded in one call

    def __init__(self, path: str, end_id: int):
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full, self.plain, self.end_id = Tokenizer.from_file(path), Tokenizer.from_file(path), end_id
        # words of lower-case letters need no normalising, and only spaces part them
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab()
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.mark = self.full.encode(self.MARK, add_special_tokens=False).ids[0]

    def _words(self, words: list[str], n: int = 20_000):
        """(ids, how many of each) of words of lower-case letters."""
        import numpy as np

        got = [np.array(self.plain.encode_batch_fast([" ".join(words[i : i + n])], add_special_tokens=False)[0].ids, np.uint32) for i in range(0, len(words), n)]
        ids = np.concatenate([np.empty(0, np.uint32), *got])
        return ids, np.diff(np.flatnonzero(self.word_end[ids]) + 1, prepend=0)

    def _chunks(self, chunks: list[str], n: int = 2_000):
        """(ids, how many of each) of any chunks."""
        import numpy as np

        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(chunks), n):
            part = chunks[i : i + n]
            if any(self.MARK in c for c in part):
                each = [e.ids for e in self.full.encode_batch_fast(part, add_special_tokens=False)]
                ids.append(np.array([x for e in each for x in e], np.uint32))
                sizes.append(np.array([len(e) for e in each], np.int64))
                continue
            got = np.array(self.full.encode_batch_fast(["".join(f"{c} {self.MARK} " for c in part)], add_special_tokens=False)[0].ids, np.uint32)
            marks = got == self.mark
            ids.append(got[~marks])
            sizes.append(np.diff(np.flatnonzero(marks), prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, texts: pa.LargeStringArray):
        """(ids of all texts, none null, where each text's ids begin and the last end)."""
        import numpy as np
        import pyarrow.compute as pc

        lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        both = pc.extract_regex(chunks, self.SPLIT)
        easy = both.is_valid()
        core, tail = pc.if_else(easy, pc.struct_field(both, "core"), chunks), pc.fill_null(pc.struct_field(both, "tail"), "")
        core, tail = core.cast(pa.large_string()), tail.cast(pa.large_string())
        words = core.filter(pc.and_(easy, pc.not_equal(core, ""))).unique()
        rest = pa.concat_arrays([core.filter(pc.invert(easy)), tail.filter(pc.not_equal(tail, ""))]).unique()
        (a, n_a), (b, n_b) = self._words(words.to_pylist()), self._chunks(rest.to_pylist())
        # one list of parts: words, rest, the empty chunk and the end id
        flat, size = np.concatenate([a, b, np.array([self.end_id], np.uint32)]), np.concatenate([n_a, n_b, [0, 1]])
        start = np.cumsum(size) - size
        parts = pa.concat_arrays([words, rest, pa.array([""], pa.large_string())])
        two = np.stack([pc.index_in(core, parts).to_numpy(), pc.index_in(tail, parts).to_numpy()], 1).ravel().astype(np.int64)
        by_chunk = gathered(flat, start[two], size[two])
        n_chunk = size[two].reshape(-1, 2).sum(1)
        by_chunk, n_chunk = np.append(by_chunk, np.uint32(self.end_id)), np.append(n_chunk, 1)
        begin = np.cumsum(n_chunk) - n_chunk
        which, at = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
        which = np.insert(which, at[1:] - at[0], len(n_chunk) - 1)  # the end id after each text
        n_each = n_chunk[which]
        cuts = np.concatenate([[0], np.cumsum(n_each)])[at - at[0] + np.arange(len(at))]
        return gathered(by_chunk, begin[which], n_each).astype("<u4"), cuts


class Bins:
    """A fixed number of open windows.

    A piece goes where it leaves the least room.  When none holds it, the fullest
    window is filled from the piece's head (a cut) or, with ``cut`` off, left as it
    is; it is emitted and its place taken by a new one.
    """

    def __init__(self, size: int, n_open: int, cut: bool):
        self.size, self.n_open, self.cut, self.bins, self.done = size, n_open, cut, [], []

    def place(self, length: int, piece: tuple) -> None:
        """piece: (document, start) of ``length`` ids."""
        doc, start = piece
        while length >= self.size:
            self.done.append([(doc, start, self.size)])
            start, length = start + self.size, length - self.size
        while length:
            fits = min((b for b in self.bins if self.size - b[0] >= length), key=lambda b: self.size - b[0], default=None)
            if fits is None and len(self.bins) < self.n_open:
                self.bins.append(fits := [0, []])
            if fits is None:
                full = max(self.bins, key=lambda b: b[0])
                self.bins.remove(full)
                if self.cut and full[0] < self.size:
                    head = self.size - full[0]
                    full[1].append((doc, start, head))
                    start, length = start + head, length - head
                self.done.append(full[1])
                continue
            fits[0] += length
            fits[1].append((doc, start, length))
            if fits[0] == self.size:
                self.bins.remove(fits)
                self.done.append(fits[1])
            return

    def close(self) -> list:
        """Merge what is still open, fullest first; returns the windows that stay short of full."""
        left, self.bins = sorted(self.bins, key=lambda b: -b[0]), []
        n, self.n_open = self.n_open, 1 if self.cut else self.n_open
        for b in left:
            for doc, start, length in b[1]:
                self.place(length, (doc, start))
        left, self.bins, self.n_open = self.bins, [], n
        return [b[1] for b in left]


def segments(text: str, most: int = TEXT_BYTES // 4) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut before a space: the tokenizer never joins across one.

    A run without a space is never cut.
    """
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def encoded(encode: Encoder, parts: list[str]) -> Iterator[bytes]:
    """The ids of each part, TEXT_BYTES of text at a time."""
    at = 0
    while at < len(parts):
        end, size = at + 1, len(parts[at])
        while end < len(parts) and size + len(parts[end]) <= TEXT_BYTES:
            size += len(parts[end])
            end += 1
        ids, cuts = encode(pa.array(parts[at:end], pa.large_string()))
        yield from (ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        at = end


def packed(docs: DataFrame, *, tokenizer_path: str, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id", window: int = 4096, n_open: int = 16, cut: bool = True, fan_in: int = 512, with_ids: bool = True) -> DataFrame:
    """Pieces of tokenised documents, packed into windows of ``window`` tokens.

    Each partition encodes its documents as they come (no shuffle of texts), keeps
    ``n_open`` open windows and places best-fit; at its end it merges them, so at
    most ``n_open`` (one, with ``cut``) short windows a partition are left.  Those
    are merged in rounds of ``fan_in`` partitions each until one group is left, so
    no task sees more than ``fan_in * n_open`` short windows.

    Returns one row per piece: the input's columns but the text, then start (ids of
    its document before it), length, token_ids (little-endian unsigned 32-bit; with
    ``with_ids`` off null, and only short windows' ids are carried), ids_crc32 (of
    token_ids), doc_tokens, sequence_id (unique, not gapless), offset (of the piece in its
    window, gapless from 0) and sequence_tokens (ids in the window; the rest up to
    ``window`` is padding).  ``end_id`` ends each document, so null and empty texts
    are one id.  Repeated rows are packed each.  Input columns named like these
    outputs are replaced.
    """
    spark = docs.sparkSession
    docs = dropped(docs, OUTPUTS)
    rest = [c for c in docs.columns if c != text_col]
    names = [f"_c{i}" for i in range(len(rest))]
    source = docs.select(F.struct(*[F.col(c).alias(n) for c, n in zip(rest, names, strict=True)]).alias("_row"), F.col(text_col).alias("_text"))
    row = source.schema["_row"].dataType.simpleString()
    schema = f"_row {row}, {PIECES}, _open boolean, _group long"

    def windows(done: list, docs: dict, first: int, is_open: bool, group: int) -> Iterator[list]:
        import zlib

        for n, pieces in enumerate(done):
            offset, total = 0, sum(p[2] for p in pieces)
            for doc, start, length in pieces:
                whole, base, n_ids, ids = docs[doc]
                own = ids[4 * start : 4 * (start + length)]
                yield [whole, base + start, length, own if with_ids or is_open else None, zlib.crc32(own), n_ids, first + n, offset, total, is_open, group]
                offset += length

    def chunks(rows: Iterator[list], row_type) -> Iterator[pa.RecordBatch]:
        kinds = [row_type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 5, pa.bool_(), pa.int64()]
        part, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names=["_row", *OUTPUTS, "_open", "_group"])
        for row in rows:
            part.append(row)
            size += len(row[3] or b"") + 256
            if size > BATCH_BYTES:
                yield batch()
                part, size = [], 0
        if part:
            yield batch()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, group = Encoder(tokenizer_path, end_id), Bins(window, n_open, cut), TaskContext.get().partitionId()
        held: dict[int, tuple] = {}
        n_doc, first, row_type = 0, group << 36, None
        rows, parts, n_parts, size = [], [], [], 0

        def placed() -> Iterator[pa.RecordBatch]:
            """Encode and place the texts gathered so far."""
            nonlocal held, n_doc, first
            coded = list(encoded(encode, parts))
            at = 0
            for i, (whole, k) in enumerate(zip(rows, n_parts, strict=True), 1):
                own = b"".join([p[:-4] for p in coded[at : at + k - 1]] + [coded[at + k - 1]])  # only the last part's end id stays
                at += k
                held[n_doc] = (whole.as_py(), 0, len(own) // 4, own)
                bins.place(len(own) // 4, (n_doc, 0))
                n_doc += 1
                if n_doc % 128 == 0 or i == len(rows):
                    yield from chunks(windows(bins.done, held, first, False, group), row_type)
                    first += len(bins.done)
                    bins.done = []
                    still = {p[0] for b in bins.bins for p in b[1]}
                    held = {k: v for k, v in held.items() if k in still}  # only what lies in an open window stays in memory

        for batch in batches:
            row_type = batch.schema.field("_row").type
            for whole, text in zip(batch.column("_row"), batch.column("_text"), strict=True):
                own = list(segments(text.as_py() or ""))
                if rows and size + sum(map(len, own)) > TEXT_BYTES:
                    yield from placed()
                    rows, parts, n_parts, size = [], [], [], 0
                    released()
                rows.append(whole)
                parts += own
                n_parts.append(len(own))
                size += sum(map(len, own))
        if row_type is not None:
            yield from placed()
            left = bins.close()
            yield from chunks(windows(bins.done, held, first, False, group), row_type)
            yield from chunks(windows(left, held, first + len(bins.done), True, group), row_type)
        del encode
        released()

    def merge(batches: Iterator[pa.RecordBatch], round_no: int, last: bool) -> Iterator[pa.RecordBatch]:
        """Groups come one after another, their short windows in order of sequence_id and offset."""
        bins, held, group, row_type, n_doc = Bins(window, n_open, cut), {}, None, None, 0

        def ended():
            first = 1 << 61 | round_no << 54 | (group << 30)
            left = bins.close()
            yield from chunks(windows(bins.done, held, first, False, group), row_type)
            yield from chunks(windows(left, held, first + len(bins.done), not last, group), row_type)

        for batch in batches:
            row_type = batch.schema.field("_row").type
            for r in (row for i in range(0, batch.num_rows, 500) for row in batch.slice(i, 500).to_pylist()):
                if group is not None and r["_group"] != group:
                    yield from ended()
                    bins, held, n_doc = Bins(window, n_open, cut), {}, 0
                group = r["_group"]
                held[n_doc] = (r["_row"], r["start"], r["doc_tokens"], r["token_ids"])
                bins.place(r["length"], (n_doc, 0))
                n_doc += 1
        if group is not None:
            yield from ended()
        released()

    pieces = written(source.mapInArrow(pack, schema), "pack")
    out, left, round_no = pieces.filter(~F.col("_open")), pieces.filter("_open"), 0
    n_groups = left.agg(F.coalesce(F.max("_group"), F.lit(-1))).first()[0] + 1
    while n_groups:
        n_groups = -(-n_groups // fan_in)
        last = n_groups <= 1
        grouped = left.withColumn("_group", F.expr(f"_group div {fan_in}")).repartition(max(1, n_groups), "_group").sortWithinPartitions("_group", "sequence_id", "offset", "_row", "start")
        done = grouped.mapInArrow(lambda it, k=round_no, z=last: merge(it, k, z), schema)
        if last:
            out = out.unionByName(done)
            break
        done = written(done, "pack-merge")
        out, left, round_no = out.unionByName(done.filter(~F.col("_open"))), done.filter("_open"), round_no + 1
    return out.select(*[F.col("_row")[n].alias(c) for c, n in zip(rest, names, strict=True)], *OUTPUTS)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens, 16 open windows a partition."""
    pieces = packed(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path=word_tokenizer(), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
