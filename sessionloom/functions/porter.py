"""The English (Porter2) stemmer, as published."""

from __future__ import annotations

import re

#: Fixed values of the algorithm: words with a stem of their own, words left alone, at once or after plural endings.
OWN_STEM = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
LEFT_ALONE = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
LEFT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes and what they become in the region R1 (steps 2 and 3) or R2 (step 4); the longest that fits counts.
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
VOWELS = "aeiouy"
REGION = re.compile(r"[aeiouy][^aeiouy]")
SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def after(word: str, start: int = 0) -> int:
    """Where the region begins behind the first consonant that follows a vowel, from ``start`` on."""
    m = REGION.search(word, start)
    return m.end() if m else len(word)


def longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def porter2(word: str) -> str:
    """The stem of a lower-case word; of two letters and less the word."""
    if word in OWN_STEM or word in LEFT_ALONE or len(word) < 3:
        return OWN_STEM.get(word, word)
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(w) if r1 is None else r1
    r2 = after(w, r1)
    has_vowel = lambda x: any(c in VOWELS for c in x)

    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in LEFT_AFTER_PLURAL:
        return w

    # past and gerund
    end = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and SHORT_END.search(w):
            w += "e"
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in VOWELS:
        w = w[:-1] + "i"

    # derivations
    end = longest(w, STEP_2)
    at = len(w) - len(end)
    if end and at >= r1 and (end != "ogi" or w[at - 1] == "l") and (end != "li" or w[at - 1] in "cdeghkmnrt"):
        w = w[:at] + STEP_2[end]
    end = longest(w, STEP_3)
    at = len(w) - len(end)
    if end and at >= (r2 if end == "ative" else r1):
        w = w[:at] + STEP_3[end]
    end = longest(w, STEP_4)
    at = len(w) - len(end)
    if end and at >= r2 and (end != "ion" or w[at - 1] in "st"):
        w = w[:at]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not SHORT_END.search(w[:-1]))) or w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")
