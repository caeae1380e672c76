"""Secret scans: patterns, and a battery of randomness tests; DataFrame functions only."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.english import STOP_WORDS
from sessionloom.llm.common import dropped, free_name, table, written

#: (kind, pattern, its group whose length counts, least length)
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
#: What may be a secret of no known form.
LEAST = 16
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
#: Encodings, the first that fits: (name, pattern, alphabet).
ENCODINGS = [
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("letters26", r"^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", r"^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("letters52", r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
LENGTHS = [19, 24, 32, 40, 64, 128]  # upper bounds of the length classes but the last
#: Lower bounds of the bins of p-values but the first: fine where words and random strings part.
EDGES = [1e-15, 1e-12, 1e-10, 1e-8, 1e-7, 1e-6, 1e-5, 1e-4, 3e-4, 1e-3, 3e-3, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
BINS = len(EDGES) + 1
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A match of a base pattern wherever it lies in a candidate.
BASE_INSIDE = "[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}"
#: Reference strings of each encoding and length class.
REFERENCES = 400
OUTPUTS = ["secret_spans"]


def found(text: Column, kind: str, number: int, pattern: str, group: int, least: int) -> Column:
    """Spans (start, kind_no, end, kind, word) in code points of the leftmost non-overlapping matches long enough."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits).alias("value"))
    none = F.expr("cast(array() as array<struct<start: int, kind_no: int, end: int, kind: string, word: string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("word"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(F.filter(hits, lambda h: F.length(h) >= least)) > 0, folded).otherwise(none)


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic approximation good to about 1e-4."""
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-300.0)), F.lit(300.0))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once: a one-element array binds it."""
    return F.transform(F.array(value), use)[0]


class Pairs(NamedTuple):
    """What the text's own words say: how much likelier each pair of letters is than by chance, and words to draw from."""

    scores: list[float]  # 27 * the first letter's place + the second's; place 0 is no letter
    moments: dict[str, tuple[float, float, float]]  # by encoding: mean, variance and next pair's covariance of a random string's scores
    words: list[tuple[str, int]]


def letter_pairs(docs: DataFrame, *, text_col: str = "text") -> Pairs:
    """Counts of letter pairs in all words of 3 to 15 letters of all documents, and the 2000 most frequent words.

    Candidates are longer than these words, so they have no part in it.  English
    stop words are added once each, for tables without words.
    """
    hits = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("(?<![a-z0-9+/_-])[a-z]{3,15}(?![a-z0-9+/_-])"), F.lit(0))
    words = written(docs.select(F.explode(hits).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "secret_words")
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    rows = words.select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    often = [(r["word"], r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(2000).collect()] + [(w, 1) for w in STOP_WORDS if len(w) > 2]
    count = [[1.0] * 27 for _ in range(27)]
    for pair, n in [(r["pair"], r["n"]) for r in rows] + [(w[i : i + 2], 1) for w in STOP_WORDS for i in range(len(w) - 1)]:
        count[LETTERS.index(pair[0]) + 1][LETTERS.index(pair[1]) + 1] += n
    scores = [math.log(26 * count[i][j] / sum(count[i][1:])) if i and j else 0.0 for i in range(27) for j in range(27)]
    moments = {}
    for name, _, alphabet in ENCODINGS:
        at = [LETTERS.find(c.lower()) + 1 for c in alphabet]
        k = len(at)
        m = [[scores[27 * i + j] for j in at] for i in at]
        mean = sum(map(sum, m)) / k**2
        var = sum(x * x for row in m for x in row) / k**2 - mean**2
        into, out = [sum(row[j] for row in m) / k for j in range(k)], [sum(row) / k for row in m]
        moments[name] = (mean, var, sum(x * y for x, y in zip(into, out, strict=True)) / k - mean**2)
    return Pairs(scores, moments, often)


def tested(word: Column, model: Pairs) -> Column:
    """(encoding, length class, bin of the battery's p-value) of a candidate.

    Three tests of the characters' places in the inferred alphabet: chi-squared
    against equal frequencies, runs above and below the middle, and correlation with
    the next character; a fourth of letter pairs that are too frequent in the text's
    words.  Their least p-value, corrected for four tests, is about uniform for a
    random string and near 0 for words.
    """
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, letters in reversed(ENCODINGS):
        encoding = F.when(word.rlike(pattern), F.lit(name)).otherwise(encoding)
        alphabet = F.when(word.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    mixed = encoding.isin([name for name, _, letters in ENCODINGS if letters.lower() != letters])
    plain = F.when(mixed, F.translate(word, "-_", "+/")).otherwise(F.lower(word))
    places = F.transform(F.split(plain, "(?!^)"), lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double"))
    folded = F.transform(F.split(F.lower(word), "(?!^)"), lambda c: F.call_function("instr", F.lit(LETTERS), c))
    table_of = F.split(F.lit(",".join(map(repr, model.scores))), ",").cast("array<double>")
    moments = [F.lit(0.0)] * 3
    for name, values in model.moments.items():
        moments = [F.when(encoding == name, F.lit(v)).otherwise(m) for v, m in zip(values, moments, strict=True)]
    zero = F.lit(0.0)

    def battery(bound: Column) -> Column:
        x, size, n = bound["x"], bound["size"], F.size(bound["x"]).cast("double")
        follow = lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        pairs = follow(x)
        counts = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda u: u == v)).cast("double"))
        chi = F.aggregate(counts, zero, lambda s, c: s + c * c) * size / n - n
        df = size - 1
        p_chi = let((F.pow(F.greatest(chi, zero) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)), normal_tail)
        runs = 1 + F.aggregate(pairs, zero, lambda s, p: s + F.when((p["a"] >= size / 2) != (p["b"] >= size / 2), 1.0).otherwise(0.0))

        def of_runs(high: Column) -> Column:
            mean_runs = 2 * high * (n - high) / n + 1
            var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
            return F.when(var_runs > 0, 2 * normal_tail(F.abs(runs - mean_runs) / F.sqrt(var_runs))).otherwise(zero)

        def of_serial(mean: Column) -> Column:
            spread = F.aggregate(x, zero, lambda s, v: s + (v - mean) * (v - mean))
            serial = F.aggregate(pairs, zero, lambda s, p: s + (p["a"] - mean) * (p["b"] - mean))
            return let(spread, lambda q: F.when(q > 0, let(serial / q * F.sqrt(n) + 1 / F.sqrt(n), lambda z: 2 * normal_tail(F.abs(z)))).otherwise(zero))

        p_runs = let(F.size(F.filter(x, lambda v: v >= size / 2)).cast("double"), of_runs)
        p_serial = let(F.aggregate(x, zero, lambda s, v: s + v) / n, of_serial)
        score = F.aggregate(follow(bound["letters"]), zero, lambda s, p: s + F.element_at(table_of, p["a"] * 27 + p["b"] + 1))
        var_score = (n - 1) * bound["m1"] + 2 * (n - 2) * bound["m2"]
        p_pairs = F.when(var_score > 0, let((score - (n - 1) * bound["m0"]) / F.sqrt(var_score), normal_tail)).otherwise(F.lit(1.0))
        return -F.expm1(4 * F.log1p(-F.least(p_chi, p_runs, p_serial, p_pairs, F.lit(1 - 1e-12))))

    length_class = F.lit(len(LENGTHS))
    for i, most in reversed(list(enumerate(LENGTHS))):
        length_class = F.when(F.length(word) <= most, F.lit(i)).otherwise(length_class)
    bound = F.struct(places.alias("x"), folded.alias("letters"), F.length(alphabet).cast("double").alias("size"), *[m.alias(f"m{i}") for i, m in enumerate(moments)])
    place = let(let(bound, battery), lambda v: F.aggregate(F.array(*[F.lit(e) for e in EDGES]), F.lit(0), lambda s, e: s + F.when(v >= e, 1).otherwise(0)))
    return F.struct(encoding.alias("encoding"), length_class.alias("length_class"), place.alias("bin"))


def references(model: Pairs) -> list[tuple[str, bool]]:
    """(string, whether random), the same in every run: random strings and word-like ones of every encoding and length class.

    The word-like ones are words of the text strung together, or numbers and words
    of hexadecimal letters where the encoding has no others.
    """
    r = random.Random(20)
    names, often = [w for w, _ in model.words], list(accumulate(n for _, n in model.words))
    number = lambda: r.choice([str(r.randint(0, 9999)), str(r.randint(1900, 2040)), f"{r.randint(0, 99):02}", f"{r.randint(0, 99999):06}", "0" * r.randint(1, 8), r.choice("0123456789") * 4, "123456789"])
    letters = lambda: r.choice(["DEAD", "BEEF", "FACE", "CAFE", "FEED", "BAD", "ADD", "FF", "ABC", "ABCDEF", "DECADE", "FFFF"])
    word = lambda: r.choices(names, cum_weights=often)[0]
    out = []
    for name, _, alphabet in ENCODINGS:
        for i in range(len(LENGTHS) + 1):
            lo, hi = (LENGTHS[i - 1] + 1 if i else LEAST), (LENGTHS[i] if i < len(LENGTHS) else 2 * LENGTHS[-1])
            for _ in range(REFERENCES):
                n = r.randint(lo, hi)
                draw = "".join(r.choice(alphabet) for _ in range(n))
                out.append((draw.upper() if name in ("hex", "base32") else draw, True))
                sep, style, parts, size = (r.choice("-_/") if r.random() < 0.7 else ""), r.choice([str.capitalize, str.lower, str.upper]), [], 0
                while size < n:
                    if name == "decimal":
                        x = number()
                    elif name == "hex":
                        x = r.choice([number, letters])()
                    elif name == "base32":
                        x = word().upper() if r.random() < 0.7 else r.choice("234567") * r.randint(1, 3)
                    elif name == "base36":
                        x = word() if r.random() < 0.7 else number()
                    elif name == "letters26":
                        x = word()
                    elif name == "letters52":
                        x = word().capitalize()
                    else:
                        x = sep * bool(parts) + (style(word()) if r.random() < 0.8 else number())
                    parts.append(x)
                    size += len(x)
                out.append(("".join(parts)[:n], False))
    return out


def random_share(classes: list[tuple[list[int], list[float], list[float]]]) -> float:
    """The most likely share of random strings among (candidates, word-like, random) histograms, as if one of each had been seen before."""
    share, total = 0.5, sum(sum(c) for c, _, _ in classes)
    for _ in range(200):
        mine = sum(k * share * u / (share * u + (1 - share) * w) for c, ws, us in classes for k, w, u in zip(c, ws, us, strict=True) if k)
        share = (mine + 1) / (total + 2)
    return share


def thresholds(docs: DataFrame, model: Pairs, *, text_col: str = "text", fdr: float = 0.1, least: int = 30) -> dict[tuple[str, int], int]:
    """The least bin taken as random, by encoding and length class.

    Reference strings, random and word-like, run through the same battery; the
    candidates are a mixture of the two, and their histogram tells the share of
    each.  The threshold is the lowest bin from which upwards the word-like ones
    expected are at most ``fdr`` of all expected; where there is none, nothing is
    marked.  A class with fewer than ``least`` candidates takes the share of all its encoding's
    classes.  Candidates that a base pattern meets don't count.  The counts cover
    every document; at most 25 rows a class come to the driver.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), F.lit(0))).alias("w")).filter(~F.col("w").rlike(BASE_INSIDE))
    rows = words.select(tested(F.col("w"), model).alias("t")).groupBy("t.encoding", "t.length_class", "t.bin").count().collect()
    if not rows:
        return {}
    known = docs.sparkSession.createDataFrame(references(model), "w string, random boolean").repartition(8)
    seen: dict[tuple[str, int, bool], list[float]] = {}
    for name, n, b, is_random, k in known.select(tested(F.col("w"), model).alias("t"), "random").groupBy("t.encoding", "t.length_class", "t.bin", "random").count().collect():
        seen.setdefault((name, n, is_random), [0.0] * BINS)[b] += k
    counts: dict[tuple[str, int], list[int]] = {}
    for name, n, b, k in rows:
        counts.setdefault((name, n), [0] * BINS)[b] += k

    def spread(name: str, n: int, is_random: bool) -> list[float]:
        c = seen.get((name, n, is_random), [0.0] * BINS)
        return [(k + 0.5 / BINS) / (sum(c) + 0.5) for k in c]

    mixed = {(name, n): (c, spread(name, n, False), spread(name, n, True)) for (name, n), c in counts.items()}
    out = {}
    for (name, n), (c, ws, us) in mixed.items():
        share = random_share([mixed[name, n]] if sum(c) >= least else [m for k, m in mixed.items() if k[0] == name])
        false = lambda b: (x := (1 - share) * sum(ws[b:])) / (x + share * sum(us[b:]))  # noqa: B023, E731
        out[name, n] = next((b for b in range(BINS) if false(b) <= fdr), BINS)
    return out


def secret_spans(docs: DataFrame, *, text_col: str = "text", fdr: float = 0.1) -> DataFrame:
    """Adds secret_spans: (start, end, kind) in code points, end exclusive, by start and then kind.

    Kinds: assign, access and hex by pattern; random by the test battery, where it
    meets none of those.  Null and empty texts have none.  Letter pairs and thresholds
    of the battery come from the words and candidates of all rows; an empty table sets none.  An
    input column of that name is replaced.
    """
    model = letter_pairs(docs, text_col=text_col)
    bins = thresholds(docs, model, text_col=text_col, fdr=fdr)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[found(text, kind, i, pattern, group, least) for i, (kind, pattern, group, least) in enumerate(BASE)])
    docs = dropped(docs, OUTPUTS)
    name = free_name(docs, "_base")
    out = docs.withColumn(name, base)
    if bins:
        limit = F.create_map(*[F.lit(x) for (name, n), b in sorted(bins.items()) for x in (f"{name}{n}", b)])
        free = F.filter(found(text, "random", len(BASE), CANDIDATE, 0, LEAST), lambda s: ~F.exists(F.col(name), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        judged = F.filter(F.transform(free, lambda s: F.struct(s.alias("s"), tested(s["word"], model).alias("t"))), lambda x: x["t"]["bin"] >= F.coalesce(limit[F.concat(x["t"]["encoding"], x["t"]["length_class"].cast("string"))], F.lit(BINS)))
        out = out.withColumn(name, F.concat(name, F.transform(judged, lambda x: x["s"])))
    return out.withColumn("secret_spans", F.transform(F.array_sort(name), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).drop(name)


def redacted(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", **how) -> DataFrame:
    """The documents with each secret replaced by ``mark``; columns as before, ``n_chars`` follows a changed text."""
    text = F.col("_text")

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    scanned = secret_spans(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), text_col="_text", **how)
    out = scanned.select("_row.*", F.when(F.size("secret_spans") > 0, clean).otherwise(text).alias("_clean"), (F.size("secret_spans") > 0).alias("_changed"))
    return out.select(*[F.col("_clean").alias(c) if c == text_col else F.when(F.col("_changed"), F.length("_clean")).otherwise(F.col(c)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    out = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("secret_spans")).alias("spans"))
