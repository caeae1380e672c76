"""Token alignment against a plain pass over all tokens of the whole corpus."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from sessionloom.llm import common, token_alignment

HOW = {"path_a": public_tokenizers.path("byte_bpe_50k.json"), "path_b": public_tokenizers.path("piece_bpe_32k.model")}


def brute(rows):
    """(id, text) -> a list of rows as op11's, in order; whole texts are encoded, cuts are a set intersection."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(HOW["path_a"]), sentencepiece.SentencePieceProcessor(model_file=HOW["path_b"])
    a.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in keep} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in keep)}
    whole, links = [], Counter()
    for i, text in rows:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba = [bytes(byte[c] for c in a.id_to_token(x)) for x in ia]
        bb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ib]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            whole.append((i, [], [], [], []))
            continue
        ends = []
        for own in (ba, bb):
            n, e = 0, []
            for x in own:
                n += len(x)
                e.append(n)
            ends.append(e)
        cuts, at, groups, own = sorted(set(ends[0]) & set(ends[1])), [0, 0], [], []
        for c in cuts:
            ja, jb = ends[0].index(c, at[0]) + 1, ends[1].index(c, at[1]) + 1
            for x in range(at[0], ja):
                for y in range(at[1], jb):
                    if max(ends[0][x] - len(ba[x]), ends[1][y] - len(bb[y])) < min(ends[0][x], ends[1][y]):
                        own.append((ia[x], ib[y]))
            groups.append(",".join(map(str, ia[at[0] : ja])) + "|" + ",".join(map(str, ib[at[1] : jb])))
            at = [ja, jb]
        links.update(own)
        whole.append((i, ia, ib, groups, own))
    most = {}
    for (_, y), n in links.items():
        most[y] = max(most.get(y, 0), n)
    return [(i, len(ia), len(ib), len(g), len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(";".join(g).encode()).hexdigest() if ia else "") for i, ia, ib, g, own in whole]


def rows_of(df, key="doc_id"):
    return sorted(tuple(r[c] for c in (key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


TEXTS = ["Hello world, it's fine.", "", None, "two  spaces   and\n\nlines \t tab", " leading and trailing ", "<|endoftext|> and <s> </s> <0x41>", "▁ itself", "naïve café — 日本語 👍🏽   nbsp", "x" * 3000, "same", "same", " ", "a b c", "1234567 890, 12.5e-3"]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "bét", "γ", "don't", "x1y2", "", " ", "\n", "　", "日本", "--", "tokenizer", "internationalization", "\x00", "😀"]
    rows = list(enumerate([*TEXTS, *(" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60))]))
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 500)
    df = spark.createDataFrame([(i, t, "old", i % 3) for i, t in rows], "doc_id long, text string, N_A string, _row int").repartition(3)
    got = token_alignment.token_alignment(df, **HOW)
    assert got.columns == ["doc_id", "_row", *token_alignment.OUTPUTS]
    assert rows_of(got) == sorted(brute(rows))
    for r in got.collect():
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] or r["groups"] == r["groups_sha256"] == ""


def test_whole_table(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    assert rows_of(token_alignment.op11_token_alignment(spark, sf)) == sorted(brute([tuple(r) for r in docs.collect()]))


def test_empty_table(spark):
    assert token_alignment.token_alignment(spark.createDataFrame([], "doc_id long, text string"), **HOW).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_leaf_groups(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 300)
    a, b = (sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n + 1)), n}) for _ in range(2))
    cuts = sorted(set(a) & set(b))
    want, at = [], (0, 0)
    for c in cuts:
        to = a.index(c) + 1, b.index(c) + 1
        want.append((at[0], to[0], at[1], to[1]))
        at = to
    assert token_alignment.leaf_groups(a, b) == want
    # the same for many intervals at once, the shared cuts of every third group known beforehand
    import numpy as np

    known = [w for k, w in enumerate(want) if k % 3 == 0]
    at_a, at_b = (np.array([w[i] for w in known] + [len(x)]) for i, x in ((0, a), (2, b)))
    for most in (64, 2):
        got = token_alignment.all_leaf_groups(np.array(a), np.array(b), at_a, at_b, most)
        assert got.tolist() == [[w[0] for w in want], [w[2] for w in want]]
