"""Token counts by section, from one encoding of each whole document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import dropped, free_name, table

OUTPUTS = ["section", "n_chars", "n_tokens", "doc_tokens"]
RULES = ("first", "largest", "split")


def byte_encoding(path: str, pattern: str):
    """A byte-level BPE of ranks in ``path``."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def allocated(start, end, lo, hi, rule: str):
    """Tokens per section: token byte spans [start, end) in order, disjoint section byte spans [lo, hi) in order.

    ``first``: a token counts where its first byte lies; ``largest``: where most of it
    lies (the earlier of equals); ``split``: in each by its share of bytes.  What lies
    in no section counts nowhere.
    """
    import numpy as np

    n = np.zeros(len(lo))
    if rule == "first":
        k = np.searchsorted(lo, start, side="right") - 1
        k = k[(k >= 0) & (start < np.append(hi, 0)[k])]
        return np.bincount(k, minlength=len(lo)).astype(float)
    # of the tokens that meet each section only its first and last can cross a border
    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        s, e = np.searchsorted(end, a, side="right"), np.searchsorted(start, b, side="left")
        if b <= a or s >= e:
            continue
        share = np.minimum(end[s:e], b) - np.maximum(start[s:e], a)
        if rule == "split":
            n[i] = (share / (end[s:e] - start[s:e])).sum()
            continue
        for t in {s, e - 1}:
            over = np.minimum(end[t], hi) - np.maximum(start[t], lo)
            n[i] += float(over.argmax() == i)
        n[i] += max(0, e - s - 2)
    return n


def token_counts(docs: DataFrame, *, ranks_path: str, pattern: str, text_col: str = "text", sections_col: str = "sections", rule: str = "first") -> DataFrame:
    """One row per document and section: its section, n_chars, n_tokens and the whole document's doc_tokens.

    ``sections_col``: array<struct<name string, start long, end long>>, code points,
    end exclusive, disjoint; they may leave gaps, are cut to the text and kept in
    their order; a null start is the text's, a null end its end, a null section none.
    Each whole text is encoded once; token spans follow from the tokens'
    byte lengths, and each token goes to a section by ``rule`` (see ``allocated``).
    Null and empty texts have 0 tokens in each section; null or no sections give no
    row.  Rows are counted each alone.  Input columns named like the outputs are
    replaced, those of text and sections left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = pa.list_(pa.struct([("section", pa.string()), ("n_chars", pa.int64()), ("n_tokens", pa.float64()), ("doc_tokens", pa.int64())]))

    @F.arrow_udf("array<struct<section: string, n_chars: long, n_tokens: double, doc_tokens: long>>")
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import numpy as np

        encoding = byte_encoding(ranks_path, pattern)
        size = np.zeros(encoding.max_token_value + 1, np.int64)
        for token in encoding.token_byte_values():
            size[encoding.encode_single_token(token)] = len(token)
        for texts, sections in batches:
            out = []
            for t, parts in zip(texts, sections.to_pylist(), strict=True):
                text = t.as_py() or ""
                parts = [p for p in parts or [] if p is not None]
                if not parts:
                    out.append([])
                    continue
                end = np.cumsum(size[np.array(encoding.encode_ordinary(text), np.int64)])
                start = np.concatenate([[0], end[:-1]]) if len(end) else end
                lead = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
                at = np.append(lead, len(text.encode()))
                for p in parts:
                    p["start"], p["end"] = p["start"] or 0, len(lead) if p["end"] is None else p["end"]
                order = sorted(range(len(parts)), key=lambda i: (parts[i]["start"], parts[i]["end"]))
                lo, hi = (at[np.clip([parts[i][k] for i in order], 0, len(lead))] for k in ("start", "end"))
                n = np.empty(len(parts))
                n[order] = allocated(start, end, lo, hi, rule)
                cut = lambda x, most=len(lead): min(max(x, 0), most)
                out.append([{"section": p["name"], "n_chars": max(0, cut(p["end"]) - cut(p["start"])), "n_tokens": float(v), "doc_tokens": len(end)} for p, v in zip(parts, n, strict=True)])
            yield pa.array(out, kind)

    rest = [c for c in dropped(docs, OUTPUTS).columns if c not in (text_col, sections_col)]
    name = free_name(docs, "_s")
    return docs.select(*rest, F.explode(count(text_col, sections_col)).alias(name)).select(*rest, f"{name}.*")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document's first line and of the rest; a token over the border counts where it begins."""
    import public_tokenizers

    text = F.coalesce("text", F.lit(""))
    size, line = F.length(text).cast("long"), F.instr(text, "\n").cast("long")
    title = F.when(line > 0, line - 1).otherwise(size)
    part = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("start"), b.alias("end"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(part("title", F.lit(0).cast("long"), title), part("body", title, size)).alias("sections"))
    return token_counts(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN).withColumn("n_tokens", F.col("n_tokens").cast("long"))
