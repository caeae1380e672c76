"""Token counts by section against the tokenizer's own offsets."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import common, token_counts

HOW = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_against_offsets(spark, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ranks = token_counts.byte_encoding(HOW["ranks_path"], HOW["pattern"])
    rows = [(1, "Title here\n\n  Body of it, with   words.\nEnd"), (2, "é ünï\ncode 日本"), (3, ""), (4, None), (5, "one line only")]
    cuts = {1: [(0, 11), (11, 30), (30, 60)], 2: [(0, 6), (6, 13)], 3: [(0, 3)], 4: [(0, 3)], 5: [(3, 8)]}
    df = spark.createDataFrame([(i, x, [(f"s{k}", a, b) for k, (a, b) in enumerate(cuts[i])], "q") for i, x in rows], "doc_id long, text string, sections array<struct<name: string, start: long, end: long>>, n_tokens string")
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["doc_tokens"]) for r in token_counts.token_counts(df, rule=rule, **HOW).collect()}
    for i, x in rows:
        b = (x or "").encode()
        spans, at = [], 0
        for token in t.encode(x or "", add_special_tokens=False).ids:
            n = len(ranks.decode_single_token_bytes(token))
            spans.append((at, at + n))
            at += n
        assert at == len(b)
        byte = lambda c: len((x or "")[: min(c, len(x or ""))].encode())
        secs = [(byte(a), byte(e)) for a, e in cuts[i]]
        for k, (a, e) in enumerate(secs):
            want = 0.0
            for s, f in spans:
                over = [max(0, min(f, y) - max(s, z)) for z, y in secs]
                want += {"first": float(a <= s < e), "largest": float(over[k] > 0 and over.index(max(over)) == k), "split": over[k] / (f - s)}[rule]
            assert got[i, f"s{k}"] == (pytest.approx(want), len(spans))


def test_whole_table(spark, sf):
    got = token_counts.op4_token_counts(spark, sf)
    docs = common.table(spark, sf, "documents")
    assert got.count() == 2 * docs.count()
    assert got.groupBy("doc_id").agg(F.sum("n_tokens").alias("a"), F.max("doc_tokens").alias("b")).filter("a != b").count() == 0
    assert token_counts.token_counts(docs.limit(0).withColumn("sections", F.expr("cast(array() as array<struct<name: string, start: bigint, end: bigint>>)")), **HOW).count() == 0
