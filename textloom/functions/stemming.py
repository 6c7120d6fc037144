"""English stems by the published suffix-stripping algorithm of Porter (1980), with the
usual later amendments, as overlap scores use it.

A word's measure is the number of its vowel-consonant turns.  Each step looks for the
first of its suffixes that the word has; the rule then applies if its condition holds
for what stands before the suffix, and else the step leaves the word alone.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and what takes their place, in the order they are tried.
_STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
)
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
_WHOLE = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant (no w, x, y), or is a vowel and a consonant."""
    k = _kinds(stem)
    return k[-3:] == "cvc" and stem[-1] not in "wxy" or k == "vc"


def _swap(word: str, rules, holds) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if holds(stem, suffix) else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    return _swap(w, (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")), lambda s, x: True)


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    stem = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
    if stem is None or "v" not in _kinds(stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _kinds(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]):
        return _second(w[:-2])
    # What stands before "ogi" is judged with the l.
    return _swap(w, _STEP_2, lambda s, x: _measure(s + "l" if x == "logi" else s) > 0)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if word in _WHOLE or len(word) <= 2:
        return _WHOLE.get(word, word)
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _kinds(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    w = _swap(_second(w), _STEP_3, lambda s, x: _measure(s) > 0)
    w = _swap(w, [(x, "") for x in _STEP_4], lambda s, x: _measure(s) > 1 and (x != "ion" or s[-1] in "st"))
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stemmed(tokens: Column) -> Column:
    """Every token of more than three characters as its stem, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def each(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: [stem(t) if len(t) > 3 else t for t in ts], na_action="ignore")

    return each(tokens)
