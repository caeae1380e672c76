"""Search of transcripts: postings, boolean and phrase queries, cover density, fuzzy match, headlines."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.english import ANALYSERS, is_stop, stems, trigram_run, trigrams, words
from sessionloom.functions.storage import written


def postings(docs: DataFrame, id_col: str, text_col: str, analyser: str = "porter2") -> DataFrame:
    """(id, pos, stem, n_words): positions count all words; stop words have no posting."""
    w = docs.select(F.col(id_col).alias("id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).withColumn("s", stems(F.col("w"), analyser))
    p = w.select("id", F.size("w").alias("n_words"), F.posexplode(F.arrays_zip("w", "s")).alias("pos", "x"))
    return p.filter(~is_stop(F.col("x.w"))).select("id", "pos", F.col("x.s").alias("stem"), "n_words")


def parsed_queries(queries: DataFrame, analyser: str = "porter2") -> DataFrame:
    """(query_id, clause, part, negated, n_terms, at, stem) of web-style strings.

    Words and "phrases" are all required; -word or -"phrase" must be absent; ``or``
    begins an alternative.  Parts of stop words only are left out.
    """
    t = queries.select("query_id", F.posexplode(F.regexp_extract_all(F.col("query"), F.lit(r'-?"[^"]+"|\S+'), F.lit(0))).alias("part", "raw"))
    w = Window.partitionBy("query_id").orderBy("part")
    t = t.withColumn("clause", F.sum((F.lower("raw") == "or").cast("int")).over(w)).filter(F.lower("raw") != "or")
    t = t.withColumn("w", words(F.col("raw"))).withColumn("s", stems(F.col("w"), analyser))
    t = t.select("query_id", "clause", "part", F.col("raw").startswith("-").alias("negated"), F.posexplode(F.arrays_zip("w", "s")).alias("at", "x")).filter(~is_stop(F.col("x.w")))
    return t.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id", "part"))).select("query_id", "clause", "part", "negated", "n_terms", "at", F.col("x.s").alias("stem"))


def matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id): documents that satisfy a clause of a query."""
    return _clauses(index, terms).select("query_id", "id").distinct()


def _parts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Where each part of a query occurs: all its terms at their distances."""
    hit = index.join(terms, "stem").groupBy("query_id", "clause", "part", "negated", "n_terms", "id", "n_words", (F.col("pos") - F.col("at")).alias("base")).agg(F.countDistinct("at").alias("k"))
    return hit.filter("k = n_terms").drop("k")


def _clauses(index: DataFrame, terms: DataFrame) -> DataFrame:
    parts = _parts(index, terms).select("query_id", "clause", "part", "negated", "id").distinct()
    need = terms.filter("not negated").groupBy("query_id", "clause").agg(F.countDistinct("part").alias("need"))
    got = parts.groupBy("query_id", "clause", "id").agg(F.count(F.when(~F.col("negated"), 1)).alias("got"), F.count(F.when(F.col("negated"), 1)).alias("barred"))
    return got.join(need, ["query_id", "clause"]).filter("got = need and barred = 0").select("query_id", "clause", "id")


def covers(hits: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The shortest stretches [start, end) that hold an occurrence (start, end, part) of every part: none holds another.

    In order of their ends; the last start of each part up to there gives a stretch,
    which counts if it starts behind the one before.
    """
    last: dict[int, int] = {}
    out, parts = [], len({p for _, _, p in hits})
    for end, same in groupby(sorted(hits, key=lambda h: h[1]), key=lambda h: h[1]):
        for start, _, part in same:
            last[part] = max(start, last.get(part, start))
        if len(last) == parts:
            first = min(last.values())
            if not out or first > out[-1][0]:
                out.append((first, end))
    return out


def ranked(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, score): matches by cover density.

    Of a clause that holds, each of its ``covers`` in the document adds 1 over its
    words; the sum is divided by the words of the document.  A document's score is
    that of its best clause.
    """
    where = _parts(index, terms).filter("not negated").join(_clauses(index, terms), ["query_id", "clause", "id"], "left_semi")
    docs = where.groupBy("query_id", "clause", "id", "n_words").agg(F.collect_list(F.struct("base", (F.col("base") + F.col("n_terms")).cast("long").alias("end"), "part")).alias("hits"))

    @F.arrow_udf("double")
    def density(hits: pa.Array, n_words: pa.Array) -> pa.Array:
        each = [[(h["base"], h["end"], h["part"]) for h in x] for x in hits.to_pylist()]
        return pa.array([sum(1 / (e - s) for s, e in covers(x)) / max(n, 1) for x, n in zip(each, n_words.to_pylist(), strict=True)], pa.float64())

    return docs.select("query_id", "id", density("hits", "n_words").alias("score")).groupBy("query_id", "id").agg(F.max("score").alias("score"))


class Placed:
    """A run of trigrams with where each occurs, for the scores of many queries."""

    def __init__(self, run: list[str]):
        self.run, self.at, self.counts = run, {}, {}
        for i, t in enumerate(run):
            self.at.setdefault(t, []).append(i)

    def repeats(self, width: int) -> list[int]:
        """At i: how many of the first i trigrams were there already among the ``width`` before them."""
        if width not in self.counts:
            last, n, out = {}, 0, [0]
            for i, t in enumerate(self.run):
                n += i - last.get(t, -width - 1) <= width
                last[t] = i
                out.append(n)
            self.counts[width] = out
        return self.counts[width]


def extent_score(wanted: set, run: list[str] | Placed, floor: float) -> float:
    """The greatest share of common trigrams among all of ``wanted`` and a stretch of ``run``; 0 if it is under ``floor``.

    A best stretch begins and ends with a wanted trigram.  Behind each such begin it
    grows; the others met so far stay in it, so it can't exceed the wanted ones over
    the wanted and the others: where that isn't more than the best found, it stops.
    A stretch that reaches ``floor`` has at least so many occurrences of wanted ones;
    where the different trigrams up to there are too many, none begins.
    """
    best, found, size = floor, 0.0, len(wanted)
    placed = run if isinstance(run, Placed) else Placed(run)
    run = placed.run
    hits = sorted(i for t in wanted if t in placed.at for i in placed.at[t])
    least, most = next((c for c in range(1, size + 1) if c / size >= floor), size + 1), len(run)
    if floor > 0:
        most = min(most, int(size / floor) + 1)
        while most >= 0 and size / (size + most) < floor:
            most -= 1
    width = 1 << max(0, most + least).bit_length()  # a power of two over what is allowed, so that few are counted
    n = placed.repeats(width)
    for k, i in enumerate(hits):
        if k + least > len(hits):
            break
        end = min(hits[k + least - 1], i + width - 1)
        if end - i - n[end + 1] + n[i + 1] >= most + least:  # different ones but one, at least
            continue
        common, other = set(), set()
        for j in range(i, len(run)):
            t = run[j]
            if t not in wanted:
                other.add(t)
                if size / (size + len(other)) < best or size / (size + len(other)) <= found:
                    break
            elif t not in common:
                common.add(t)
                share = len(common) / (size + len(other))
                if share >= best and share > found:
                    best = found = share
                    while least <= size and least / size <= found:
                        least += 1
                    while most > 0 and size / (size + most) <= found:
                        most -= 1
    return found


def fuzzy(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, *, floor: float = 0.35) -> DataFrame:
    """(query_id, id, score): documents with a stretch like the query.

    The score is the greatest share of common trigrams among all of the query and any
    stretch of the document's trigrams, see ``extent_score``.  A document that reaches
    ``floor`` holds that share of the query's trigrams, so one at least of all but so
    many of them: only documents with one of the query's rarest are looked at, and
    frequent trigrams join nothing.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    q = queries.select("query_id", "query", trigrams(F.col("query")).alias("tq")).withColumn("n", F.size("tq")).filter("n > 0")
    each = q.select("query_id", "n", F.explode("tq").alias("t"))
    held = d.select("id", F.explode(trigrams(F.col("text"))).alias("t"))
    often = held.join(each.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("docs", F.lit(0)), "t"))
    rare = each.join(often, "t", "left").withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(floor) * F.col("n") - 1e-9) + 1)
    # dealt by number, so that few bytes don't become one task; a document's pairs follow one another
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rare.select("query_id", "t").join(held, "t").select("query_id", "id").distinct().repartition(tasks, "id").sortWithinPartitions("id")
    pairs = near.join(q.select("query_id", "query"), "query_id").join(d, "id")

    @F.arrow_udf("double")
    def score(query: pa.Array, text: pa.Array) -> pa.Array:
        out, sets, last, run = [], {}, None, None
        for a, b in zip(query.to_pylist(), text.to_pylist(), strict=True):
            if b != last:
                last, run = b, Placed(trigram_run(b))
            wanted = sets[a] if a in sets else sets.setdefault(a, set(trigram_run(a)))
            out.append(extent_score(wanted, run, floor))
        return pa.array(out, pa.float64())

    return pairs.select("query_id", "id", score("query", "text").alias("score")).filter(F.col("score") >= floor)


def search(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, *, limit: int = 20, floor: float = 0.35, analyser: str = "porter2") -> DataFrame:
    """(query_id, id, score, fuzzy, rank): strict matches; for queries that have none, fuzzy ones."""
    strict = written(ranked(postings(docs, id_col, text_col, analyser), parsed_queries(queries, analyser)).withColumn("fuzzy", F.lit(False)), "strict")
    rest = queries.join(strict.select("query_id").distinct(), "query_id", "left_anti")
    both = strict.unionByName(fuzzy(docs, rest, id_col, text_col, floor=floor).withColumn("fuzzy", F.lit(True)))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def fragment(flags: list, least: int, most: int) -> tuple[int, int]:
    """The words [from, to) to show; ``flags``: per word the stem it matches, or None.

    Of stretches of up to ``most`` words between two matches the one with the most
    different stems counts, then with the most matches, the shortest, the earliest;
    up to ``least`` words are shown, those behind it first.  Without a match: the begin.
    """
    at = [i for i, f in enumerate(flags) if f is not None]
    best, count, seen, k = None, Counter(), 0, 0
    for n, i in enumerate(at):
        while k < len(at) and at[k] < i + most:
            count[flags[at[k]]] += 1
            k += 1
        seen = len(count)
        best = max(best or (0, 0, 0, 0), (seen, k - n, -(at[k - 1] + 1 - i), -i))
        count[flags[i]] -= 1
        if not count[flags[i]]:
            del count[flags[i]]
    start, end = (-best[3], -best[3] - best[2]) if best else (0, 0)
    end = max(end, min(len(flags), start + least))
    return max(0, min(start, end - least)), end


def headline(text_col: str, stems_col: str, *, least: int = 10, most: int = 30, analyser: str = "porter2") -> F.col:
    """The best ``fragment`` of a text as it is, matches in [[ and ]]; of a null text null."""

    @F.arrow_udf("string")
    def shown(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        stem_of, out = ANALYSERS[analyser], []
        for text, own in zip(texts.to_pylist(), wanted.to_pylist(), strict=True):
            if text is None:
                out.append(None)
                continue
            found, own = [m.span() for m in re.finditer("[A-Za-z0-9]+", text)], set(own or [])
            flags = [s if (s := stem_of(text[a:b].lower())) in own else None for a, b in found]
            start, end = fragment(flags, least, most)
            line, at = [], found[start][0] if end > start else 0
            for (a, b), f in zip(found[start:end], flags[start:end], strict=True):
                line += [text[at:a], f"[[{text[a:b]}]]" if f is not None else text[a:b]]
                at = b
            out.append("".join(line))
        return pa.array(out, pa.string())

    return shown(text_col, stems_col)


def snippet_segments(snippet: F.col) -> F.col:
    """A bracketed snippet as (text, match) runs, empty ones left out."""
    runs = F.regexp_extract_all(snippet, F.lit(r"(?s)\[\[.*?\]\]|(?:(?!\[\[).)+"), F.lit(0))
    return F.transform(runs, lambda r: F.when(r.startswith("[["), F.struct(r.substr(F.lit(3), F.length(r) - 4).alias("text"), F.lit(True).alias("match"))).otherwise(F.struct(r.alias("text"), F.lit(False).alias("match"))))
