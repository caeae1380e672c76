"""English analysers: a light one made of patterns, and the published Porter2 stemmer."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions.porter import porter2

#: Words that carry no search term.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "he", "in", "is", "it", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "we", "were", "with", "you"]
#: (suffix pattern, what is left of it), one after another.
SUFFIXES = [(r"(ss|sh|ch|x|z)es$", r"\1"), (r"ies$", "i"), (r"([^su])s$", r"\1"), (r"^([a-z]{3,})(ed|ing)$", r"\1"), (r"^([a-z]{3,})ly$", r"\1"), (r"^([a-z]{3,})e$", r"\1"), (r"^([a-z]{2,})y$", r"\1i")]


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def stem(word: Column) -> Column:
    for pattern, rest in SUFFIXES:
        word = F.regexp_replace(word, pattern, rest.replace("\\1", "$1"))
    return word


@lru_cache(100_000)
def light(word: str) -> str:
    """``stem`` of one word."""
    for pattern, rest in SUFFIXES:
        word = re.sub(pattern, rest, word)
    return word


@lru_cache(100_000)
def porter(word: str) -> str:
    return porter2(word)


ANALYSERS = {"light": light, "porter2": porter}


def stems(each: Column, analyser: str = "porter2") -> Column:
    """The stems of an array of words; each distinct word of a batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def of(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        done = pa.array([ANALYSERS[analyser](w) for w in flat.dictionary.to_pylist()], pa.string())
        first = lists.offsets[0].as_py() if len(lists) else 0
        offsets = pa.array([None if not ok else o - first for o, ok in zip(lists.offsets.to_pylist(), [*lists.is_valid().to_pylist(), True], strict=True)], pa.int32())
        return pa.ListArray.from_arrays(offsets, done.take(flat.indices))

    return of(each)


def is_stop(word: Column) -> Column:
    return word.isin(STOP_WORDS)


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each word, with two spaces before it and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3))))))


def trigram_run(text: str) -> list[str]:
    """All of them in order of the text, repeated ones too."""
    out = []
    for w in re.findall("[a-z0-9]+", text.lower()):
        w = f"  {w} "
        out += [w[i : i + 3] for i in range(len(w) - 2)]
    return out
