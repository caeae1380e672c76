"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.storage import discard
from sessionloom.llm.common import dropped, free_name, released, table, written

OUTPUTS = ["n_words", "n_hit", "item_ids", "spans"]
RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<word_start: long, word_end: long, byte_start: long, byte_end: long>>"


def word_table() -> bytes:
    """A byte map: A-Z to a-z, ASCII that is neither digit nor letter to a space."""
    keep = b"0123456789abcdefghijklmnopqrstuvwxyz"
    return bytes(b if b >= 0x80 or b in keep else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Automaton:
    """Generalised suffix automaton over word ids of test items.

    ``window``: an item of that many words or more is known by its runs of
    ``window`` words, a shorter one by the whole item.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}  # numbers of words
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if ids:
                coded.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.least = min((min(window, len(ids)) for _, ids in coded), default=0)
        self._freeze(coded)

    def _freeze(self, coded: list[tuple[str, list[int]]]) -> None:
        """Flat arrays in place of a dictionary a state: most states have one way on, and most windows one item."""
        n, window = len(self.link), self.window
        none = array("i", [-1])
        self.names = [name for name, _ in coded]
        one_of, more_of = none * n, {}  # the items of a state's window: the first, and the others
        ends: dict[int, list[tuple[int, int]]] = {}
        for item, (_, ids) in enumerate(coded):
            state = 0
            for k, c in enumerate(ids, 1):
                state = self.next[state][c]
                if k >= window:
                    at = self._holder(state, window)
                    if one_of[at] < 0:
                        one_of[at] = item
                    elif one_of[at] != item:
                        more_of.setdefault(at, set()).add(item)
            if len(ids) < window:
                ends.setdefault(self._holder(state, len(ids)), []).append((len(ids), item))
        # items of under `window` words that end in a state or in one of its suffixes
        self.short: dict[int, list[tuple[int, int]]] = {}
        for s in sorted(range(1, n), key=self.length.__getitem__) if ends else ():
            above = self.short.get(self.link[s], [])
            if s in ends or above:
                self.short[s] = above + ends[s] if s in ends else above
        # the state that stands for the last `window` words
        self.at_window = array("i", (self._holder(s, window) if k >= window else 0 for s, k in enumerate(self.length)))
        self.one_of, self.more_of = one_of, more_of
        self.char, self.to, self.ways = none * n, none * n, {}
        self.root = none * len(self.vocab)
        for c, to in self.next[0].items():
            self.root[c] = to
        for s in range(1, n):
            ways = self.next[s]
            if ways:
                c, to = ways.popitem()
                self.char[s], self.to[s] = c, to
                if ways:
                    self.ways[s] = ways
        self.next = []
        self.link, self.length = array("i", self.link), array("i", self.length)

    def _holder(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _split(self, p: int, q: int, c: int) -> int:
        clone = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Word ranges [start, end) covered by windows, merged where they touch or overlap, and the items they belong to."""
        import itertools

        import numpy as np

        found: list[list[int]] = []
        items: set[int] = set()
        n = len(words)
        if not self.least or n < self.least:
            return found, set()
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(-1)), np.int64, n)
        stops = np.concatenate(([-1], np.flatnonzero(ids < 0), [n]))  # an unknown word leads back to the root
        runs = np.flatnonzero(np.diff(stops) > self.least)
        char, to_of, ways, root, link, length, window = self.char, self.to, self.ways, self.root, self.link, self.length, self.window
        short, one_of, more_of, at_window = self.short, self.one_of, self.more_of, self.at_window
        for r in runs.tolist():
            at = int(stops[r]) + 1
            state = n_match = 0
            for i, c in enumerate(ids[at : stops[r + 1]].tolist(), at + 1):
                while state:
                    if char[state] == c:
                        to = to_of[state]
                    else:
                        to = ways[state].get(c, -1) if state in ways else -1
                    if to >= 0:
                        break
                    state = link[state]
                    n_match = length[state]
                else:
                    to = root[c]
                state = to
                n_match += 1
                take = 0
                if n_match >= window:
                    take = window
                    held = at_window[state]
                    if one_of[held] >= 0:
                        items.add(one_of[held])
                        if held in more_of:
                            items |= more_of[held]
                if state in short:
                    for k, item in short[state]:
                        if k <= n_match:
                            take = max(take, k)
                            items.add(item)
                if take:
                    start = i - take
                    while found and start <= found[-1][1]:
                        start = min(start, found.pop()[0])
                    found.append([start, i])
        return found, {self.names[i] for i in items}


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def block_of(benchmark: DataFrame, i: int, n_blocks: int, *, item_id_col: str, item_text_col: str, window: int) -> Automaton:
    """The automaton of the benchmark's block ``i``: the items whose hash falls there; only they are fetched."""
    bytemap = word_table()
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("name"), F.col(item_text_col).alias("words")).distinct()
    mine = items.filter(F.pmod(F.xxhash64("name", "words"), F.lit(n_blocks)) == i).collect()
    return Automaton([(name, (text or "").encode().translate(bytemap).split()) for name, text in mine], window)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """Where each document repeats a test item.

    Words: runs of ASCII letters (case folded), digits and non-ASCII characters.
    An item's windows: its runs of ``window`` words; a shorter item, if it has a
    word, is one window.  The documents' words run through the automaton, which
    tracks the longest match ending at each word; no row moves.  A benchmark of over
    ``block_bytes`` bytes of text goes in blocks, one broadcast and one pass each, the
    passes' spans merged; a single longer item is one block.

    Adds n_words, n_hit (words inside an occurrence of a window), item_ids (sorted,
    distinct; items any of whose windows occur) and spans (maximal ranges of hit
    words with their UTF-8 byte ranges in the text).  Null or empty text: no words,
    no hits.  Items with null or empty text have no window; a null item id reads
    "null".  Repeated rows each get their own answer.  An empty benchmark hits
    nothing.  Input columns named like these outputs are replaced.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(k, pa.int64()) for k in ("word_start", "word_end", "byte_start", "byte_end")])))])

    def scanner(auto: Automaton):
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(auto))  # with its class, which executors need not have

        @F.arrow_udf(RESULT)
        def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            import pickle
            import re

            auto, bytemap, word = pickle.loads(shared.value), word_table(), re.compile(rb"[^ ]+")
            for texts, before in batches:
                out = []
                for value, last in zip(texts, before, strict=True):
                    text = value.as_py()
                    if not text:
                        out.append({"n_words": 0, "n_hit": 0, "item_ids": [], "spans": []})
                        continue
                    plain = text.encode().translate(bytemap)
                    words = plain.split()
                    found, items = auto.hits(words)
                    if last.is_valid:
                        known = last.as_py()
                        found = merged(found + [[s["word_start"], s["word_end"]] for s in known["spans"]])
                        items = items | set(known["item_ids"])
                    spans = []
                    if found:
                        at = [m.span() for m in word.finditer(plain)]
                        spans = [{"word_start": s, "word_end": e, "byte_start": at[s][0], "byte_end": at[e - 1][1]} for s, e in found]
                    out.append({"n_words": len(words), "n_hit": sum(e - s for s, e in found), "item_ids": sorted(items), "spans": spans})
                yield pa.array(out, kind)
                del out
                released()

        return scan

    docs = dropped(docs, OUTPUTS)
    name = free_name(docs, "_found")
    out, last = docs.withColumn(name, F.lit(None).cast("struct<" + RESULT + ">")), None
    for i in range(n_blocks):
        auto = block_of(benchmark, i, n_blocks, item_id_col=item_id_col, item_text_col=item_text_col, window=window)
        out = out.withColumn(name, scanner(auto)(F.col(text_col), F.col(name)))
        if i + 1 < n_blocks:
            out = written(out, "contamination")
            if last is not None:  # what the pass before wrote has been read
                discard(last)
            last = out
    return out.select(*docs.columns, f"{name}.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", max_span_words: int = 0, max_coverage: float = 0.5, **how) -> DataFrame:
    """Documents without what they share with the benchmark.

    A span of more than ``max_span_words`` hit words is cut from the text (with 0
    every span; shorter ones stay); a document more than ``max_coverage`` of
    whose words are hit goes as a whole.  Columns stay those of ``docs``;
    ``n_chars``, if there is one, follows the text.  Untouched texts stay byte for
    byte, null ones null.
    """
    found = contamination(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), benchmark, text_col="_text", **how)
    found = found.withColumn("spans", F.filter("spans", lambda s: s["word_end"] - s["word_start"] > max_span_words))
    pieces = F.expr(
        "concat_ws('', transform(sequence(0, size(spans)), i -> "
        "decode(substring(encode(_text, 'UTF-8'), int(if(i = 0, 0, spans[i - 1].byte_end)) + 1, "
        "int(if(i = size(spans), octet_length(_text), spans[i].byte_start) - if(i = 0, 0, spans[i - 1].byte_end))), 'UTF-8')))"
    )
    kept = found.filter(F.col("n_hit") <= max_coverage * F.col("n_words"))
    text = F.when(F.size("spans") == 0, F.col("_text")).otherwise(pieces)
    out = kept.select("_row.*", text.alias("_clean"))
    columns = [F.col("_clean").alias(c) if c == text_col else F.when(F.col("_clean").isNull() | (F.col("_clean") == F.col(text_col)), F.col(c)).otherwise(F.length("_clean")).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return out.select(*columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of 10 words."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same by plain joins of window hashes.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
      FROM b, LATERAL unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
      FROM d, sizes, LATERAL unnest(generate_series(1, len(w) - k + 1)) AS t(i) WHERE len(w) >= k),
m AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON p.k = g.k AND p.s = g.s),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM m, LATERAL unnest(generate_series(i, i + k - 1)) AS t(j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
