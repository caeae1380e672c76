"""Shards, URL verdicts and secret batteries against plain Python versions and planted cases."""

import math
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from sessionloom.llm import common, secrets, sharding, url_filters


def drawn(name, key):
    """-ln(u) of a child and a key by the hash that Spark chains over both."""
    h = xxhash.xxh64_intdigest(name.encode(), 42)
    if key is not None:
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)
    return -math.log(((h >> 11) + 1) / float(1 << 53))


def shard_of(node, key):
    while node.children:
        node = min(node.children, key=lambda c: drawn(c.name, key) / c.weight)
    return node.shard


def test_descent(spark):
    nodes = sharding.tree(37, weights={3: 2.5, 20: 0.25})
    got = spark.range(-300, 300).select("id", sharding.descended(nodes, F.col("id")).alias("s")).collect()
    assert [r["s"] for r in got] == [shard_of(nodes, r["id"]) for r in got]
    assert spark.range(1).select(sharding.descended(nodes, F.lit(None).cast("long")).alias("s")).first()[0] == shard_of(nodes, None)
    big = spark.range(20_000).select(sharding.descended(sharding.tree(1000), F.col("id")).alias("s")).distinct().count()
    assert big > 990


def test_whole_table_of_shards(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = sharding.op7_sharding(spark, sf).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "key")
        assert r["shard"] == shard_of(sharding.tree(16), r["doc_id"]) and r["grown_shard"] == shard_of(sharding.tree(17), r["doc_id"])
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def cut(shape, depth):
    seg = shape.split("/")[1:]
    return seg if len(seg) <= depth else [*seg[: depth - 1], "/".join(seg[depth - 1 :])]


def plain_templates(shapes, most, depth):
    """{shape: template} of one host; shapes: {shape: rows}."""
    out = {}

    def node(own, level, prefix):
        if len(own) <= most or all(len(cut(s, depth)) <= level for s in own):
            out.update({s: "/".join([prefix, *cut(s, depth)[level:]]) for s in own})
            return
        out.update({s: prefix for s in own if len(cut(s, depth)) <= level})
        own = [s for s in own if len(cut(s, depth)) > level]
        rows = {}
        for s in own:
            rows[cut(s, depth)[level]] = rows.get(cut(s, depth)[level], 0) + shapes[s]
        below = {}
        for s in own:
            name = cut(s, depth)[level]
            rare = len(rows) > most and 10 * rows[name] < sum(rows.values())
            below.setdefault("*" if rare else name, []).append(s)
        for name, part in below.items():
            node(part, level + 1, f"{prefix}/{name}")

    node(list(shapes), 0, "")
    return out


def plain_branches(marks, z, depth):
    """{template: branch} of one host; marks: {template: (labels, good)}."""
    at, apart = {t: ["", *cut(t, depth)] for t in marks}, set()
    for level in range(max(map(len, at.values())), 1, -1):
        sums = {}
        for t, p in at.items():
            if t not in apart and len(p) == level:
                k, g = sums.get(tuple(p), (0, 0))
                sums[tuple(p)] = k + marks[t][0], g + marks[t][1]
        differs = set()
        for p, (k, g) in sums.items():
            k0 = sum(v[0] for q, v in sums.items() if q[:-1] == p[:-1]) - k
            g0 = sum(v[1] for q, v in sums.items() if q[:-1] == p[:-1]) - g
            if k and k0 and 0 < g + g0 < k + k0:
                rate = (g + g0) / (k + k0)
                if abs(g / k - g0 / k0) / math.sqrt(rate * (1 - rate) * (1 / k + 1 / k0)) >= z:
                    differs.add(p)
        for t, p in list(at.items()):
            if t not in apart and len(p) == level:
                if tuple(p) in differs:
                    apart.add(t)
                else:
                    at[t] = p[:-1]
    return {t: "/".join(p) for t, p in at.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_url_verdicts(spark, seed):
    r = random.Random(seed)
    word = lambda n: "w" + "".join(r.choice("abcdefgh") for _ in range(n))
    bad = {f"h{h}.com": {word(1) for _ in range(3)} for h in range(3)}
    urls = []
    for _ in range(1500):
        host = r.choice(list(bad))
        parts = [r.choice(["news", "shop", "u", *bad[host]]), *(word(r.choice([1, 1, 3])) for _ in range(r.choice([0, 1, 1, 2, 3, 5])))]
        good = int(r.random() > (0.9 if parts[0] in bad[host] else 0.2))
        urls.append((f"http://{host}/{'/'.join(parts)}", good if r.random() < 0.5 else None))
    urls += [("http://h0.com/trap" + "/a" * k, None) for k in range(60)] + [(None, 1), ("none", 0), ("http://h1.com", 1)]
    df = spark.createDataFrame(urls, "url string, label int")
    got = {(x["url"], x["template"], x["verdict"]) for x in url_filters.url_verdicts(df.select("url"), df, max_depth=8).collect()}

    host_path = lambda u: (("", "") if u is None or "://" not in u else (lambda s: (s.partition("/")[0], "".join(s.partition("/")[1:])))(u.split("://")[1]))
    judges = lambda u: xxhash.xxh64_intdigest(u.encode(), 42) & 1 if u is not None else 42 & 1
    labels = [y for _, y in urls if y is not None]
    overall, want = sum(labels) / len(labels), set()
    for host in {host_path(u)[0] for u, _ in urls}:
        own = [(u, host_path(u)[1], y) for u, y in urls if host_path(u)[0] == host]
        shapes = {}
        for _, p, _ in own:
            shapes[p] = shapes.get(p, 0) + 1
        template = plain_templates(shapes, 12, 8)
        marks = {t: (0, 0) for t in template.values()}
        for u, p, y in own:
            if y is not None and not judges(u):
                k, g = marks[template[p]]
                marks[template[p]] = k + 1, g + y
        branch, held = plain_branches(marks, 1.96, 8), {}
        for u, p, y in own:
            if y is not None and judges(u):
                k, g = held.get(branch[template[p]], (0, 0))
                held[branch[template[p]]] = k + 1, g + y
        for u, p, _ in own:
            k, g = held.get(branch[template[p]], (0, 0))
            want.add((u, template[p], "block" if k and (g + 10 * overall) / (k + 10) < 0.6 else "allow"))
    assert got == want
    assert {v for _, _, v in want} == {"allow", "block"}


def test_deep_paths_end(spark):
    """Thirty levels, then a path of 3000 segments: the rounds don't follow the depth."""
    urls = [("http://a.com/" + "/".join(f"s{i}" for i in range(k)), 1) for k in (1, 30, 3000)]
    df = spark.createDataFrame(urls, "url string, label int")
    assert url_filters.url_verdicts(df.select("url"), df).filter("verdict = 'allow'").count() == 3


def test_planted_secrets(spark):
    """Of random keys of nine alphabets nearly all are marked, of slugs, paths and names nearly none."""
    r = random.Random(11)
    alphabets = ["0123456789abcdef".upper(), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    vocabulary = "the customer account service of river mountain report analysis system table morning winter garden people market global network summer little yellow building window station paper letter number second minute picture example question answer history science language".split()
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    keys = [(i, prose(20) + " " + "".join(r.choice(alphabets[i % 9]) for _ in range(r.choice([20, 24, 32, 40, 64]))) + " " + prose(20)) for i in range(900)]
    slugs = [(10_000 + i, prose(20) + " " + r.choice(["-", "_", "/"]).join(r.choice(vocabulary) for _ in range(r.randrange(3, 8))) + " " + prose(20)) for i in range(1500)]
    docs = spark.createDataFrame([*keys, *slugs], "doc_id long, text string").repartition(4)
    marked = {x["doc_id"] for x in secrets.secret_spans(docs).filter(F.exists("secret_spans", lambda s: s["kind"] == "random")).select("doc_id").collect()}
    assert len([i for i, _ in keys if i in marked]) >= 0.95 * len(keys)
    assert len([i for i, _ in slugs if i in marked]) <= 0.02 * len(slugs)
