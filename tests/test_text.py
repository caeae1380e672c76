"""Search: stems, stored index, cover density, extents and fragments against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sessionloom.functions.english import ANALYSERS, stem, trigram_run
from sessionloom.functions.porter import porter2
from sessionloom.operators import search_index as ix
from sessionloom.operators import text as tx

STEMS = "consigned consign|consistency consist|consistently consist|consolatory consolatori|consolingly consol|conspicuously conspicu|conspiracies conspiraci|conspirators conspir|constancy constanc|knackeries knackeri|kneeled kneel|knightly knight|knives knive|hopping hop|hoping hope|cries cri|tie tie|ties tie|gas gas|this this|kiwis kiwi|bled bled|luxuriated luxuri|agreed agre|feed feed|generate generat|communication communic|internationalization internation|skies sky|dying die|news news|proceed proceed|by by|say say|happily happili|x1y2 x1y2"


def test_porter2_on_published_pairs():
    assert [(w, porter2(w)) for w, _ in map(str.split, STEMS.split("|"))] == [tuple(x.split()) for x in STEMS.split("|")]


def test_light_stems_agree(spark):
    words = ["classes", "flies", "runs", "walked", "walking", "quickly", "care", "happy", "bus", "boxes", "a", "99", "ties"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", stem(F.col("w")).alias("s")).collect()} == {w: ANALYSERS["light"](w) for w in words}


@pytest.mark.parametrize("seed", range(30))
def test_covers(seed):
    r = random.Random(seed)
    hits = [(s := r.randrange(40), s + r.randrange(1, 4), r.randrange(3)) for _ in range(r.randrange(1, 14))]
    parts = {p for _, _, p in hits}
    holds = lambda a, b: {p for s, e, p in hits if a <= s and e <= b} == parts
    want = [(a, b) for a in range(45) for b in range(a + 1, 46) if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)]
    assert tx.covers(hits) == want


@pytest.mark.parametrize("seed", range(40))
def test_extents(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 6)))
    wanted, run = set(trigram_run(" ".join(word() for _ in range(r.randrange(1, 4))))), trigram_run(" ".join(word() for _ in range(r.randrange(0, 12))))
    best = max((len(wanted & (e := set(run[i:j]))) / len(wanted | e) for i in range(len(run)) for j in range(i + 1, len(run) + 1)), default=0)
    got = tx.extent_score(wanted, run, 0.35)
    assert got == pytest.approx(best) if best >= 0.35 else got == 0


def test_extent_goes_over_many_words():
    wanted = set(trigram_run("internationalization"))
    run = trigram_run("so inter national iza tion it is")
    stretches = [set(run[i:j]) for i in range(len(run)) for j in range(i + 1, len(run) + 1)]
    assert tx.extent_score(wanted, run, 0.35) == max(len(wanted & e) / len(wanted | e) for e in stretches) > 0.5
    assert tx.extent_score(set(trigram_run("word")), trigram_run("two words"), 0.35) == 0.8


@pytest.mark.parametrize("seed", range(30))
def test_fragments(seed):
    r = random.Random(seed)
    flags = [r.choice("xyz") if r.random() < 0.15 else None for _ in range(r.randrange(0, 90))]
    least, most = 10, 30
    at = [i for i, f in enumerate(flags) if f]
    rank = lambda i, j: (-len({flags[k] for k in at if i <= k < j}), -sum(i <= k < j for k in at), j - i, i)
    cases = [(i, j + 1) for i in at for j in at if i <= j < i + most]
    start, end = min(cases, key=lambda c: rank(*c)) if cases else (0, 0)
    end = max(end, min(len(flags), start + least))
    assert tx.fragment(flags, least, most) == (max(0, min(start, end - least)), end)


TALK = ["The cat sat on the mat.", "Cats and dogs; a dog sat, then the cat ran.", None, "", "Dog days. " + "filler " * 40 + "the running dog and a cat", "internationalisation of cats", "sitting dogs"]


def test_search_and_headlines(spark):
    docs = spark.createDataFrame(list(enumerate(TALK)), "id long, text string")
    queries = spark.createDataFrame([(1, "cat dog"), (2, '"dog sat"'), (3, "internationalization"), (4, "cats -dogs"), (5, "the")], "query_id long, query string")
    got = [(r["query_id"], r["id"], r["fuzzy"], r["rank"], round(r["score"], 6)) for r in tx.search(docs, queries, "id", "text").orderBy("query_id", "rank").collect()]
    # 1: document 1 is cats.dogs (3 words), dogs..dog (no cat), dog..cat (5): 1/3 + 1/5 + ... over its words
    dense = {(q, i): s for q, i, _, _, s in got}
    words = [re.findall("[a-z0-9]+", (t or "").lower()) for t in TALK]
    for q, wanted in ((1, {"cat", "dog"}),):
        for i in (1, 4):
            hits = [(k, k + 1, porter2(w)) for k, w in enumerate(words[i]) if porter2(w) in wanted]
            stretches = tx.covers([(s, e, sorted(wanted).index(p)) for s, e, p in hits])
            assert dense[q, i] == round(sum(1 / (e - s) for s, e in stretches) / len(words[i]), 6)
    assert {(q, i) for q, i, fuzzy, _, _ in got if not fuzzy} == {(1, 1), (1, 4), (2, 1), (4, 0), (4, 5)}
    assert (3, 5) in dense
    shown = docs.withColumn("stems", F.array(F.lit("cat"), F.lit("dog"))).select("id", tx.headline("text", "stems").alias("h"))
    lines = {r["id"]: r["h"] for r in shown.collect()}
    assert lines[0] == "The [[cat]] sat on the mat" and lines[2] is None and lines[3] == ""
    assert lines[1] == "[[Cats]] and [[dogs]]; a [[dog]] sat, then the [[cat]] ran"
    assert lines[4].endswith("the running [[dog]] and a [[cat]]") and len(lines[4].split()) == 10


def test_fuzzy_against_all_pairs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(2, 7)))
    docs = [(i, " ".join(word() for _ in range(r.randrange(0, 15))) or None) for i in range(60)]
    asked = [(i, " ".join(word() for _ in range(r.randrange(1, 4)))) for i in range(12)]
    got = {(x["query_id"], x["id"]): x["score"] for x in tx.fuzzy(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "query_id long, query string"), "id", "text").collect()}
    want = {(q, i): s for q, a in asked for i, t in docs if (s := tx.extent_score(set(trigram_run(a)), trigram_run(t or ""), 0.35)) >= 0.35}
    assert want and got == want


def test_index_by_document(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame(list(enumerate(TALK)), "id long, text string")
    assert ix.index_documents(docs, path) == 0
    terms = tx.parsed_queries(spark.createDataFrame([(1, "cat dog"), (2, "run"), (3, '"the mat"')], "query_id long, query string"))
    hits = lambda: sorted(tuple(x) for x in tx.matches(ix.looked_up(spark, path, terms), terms).collect())
    assert hits() == [(1, 1), (1, 4), (2, 4), (3, 0)]
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    whole = tx.postings(docs, "id", "text").join(terms.select("stem").distinct(), "stem", "left_semi").select("id", "pos", "stem", "n_words")
    assert rows(ix.looked_up(spark, path, terms)) == rows(whole)
    # one document changed, one new, one gone: a generation with their rows alone
    changed = spark.createDataFrame([(1, "nothing here"), (7, "a cat, a dog")], "id long, text string")
    assert ix.index_documents(changed, path, removed=docs.filter("id = 4").select("id")) == 1
    assert spark.read.parquet(f"{path}/postings/generation=1").select("id").distinct().count() == 2
    assert hits() == [(1, 7), (3, 0)]
    plan = ix.looked_up(spark, path, terms)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    # a generation whose documents aren't listed was cut off, and isn't seen
    spark.createDataFrame([(0, 1, "cat", [0])], "id long, n_words int, stem string, deltas array<int>").withColumn("bucket", ix.bucket_of(F.col("stem"), 64)).write.partitionBy("bucket").parquet(f"{path}/postings/generation=2")
    assert hits() == [(1, 7), (3, 0)] and ix.index_documents(docs.limit(0), path) == 2


def test_fuzzy_scores_in_many_tasks(spark):
    docs = spark.createDataFrame([(i, f"word number {i} of many words") for i in range(200)], "id long, text string")
    asked = spark.createDataFrame([(1, "numbre"), (2, "wordz")], "query_id long, query string")
    got = tx.fuzzy(docs, asked, "id", "text").withColumn("task", F.spark_partition_id())
    assert got.select("task").distinct().count() > 1
    run = trigram_run("word of word and words")
    assert tx.extent_score(set(trigram_run("words")), tx.Placed(run), 0.35) == tx.extent_score(set(trigram_run("words")), run, 0.35) == 1.0
