"""Tokenizers and text scalars as Column functions.

All are whole-stage JVM expressions.  Words are judged by Unicode classes spelled
out, since Java's plain word class and word boundary are ASCII.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import CZECH_LETTERS, EDIT_ALPHABET, INDEX_STOP, PUNCTUATION, STOP_CS

_WORD = r"\p{L}\p{N}_"


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def without(tokens: Column, stop: Sequence[str]) -> Column:
    """The tokens that are no stop words, repeats kept."""
    return F.filter(tokens, lambda x: ~x.isin(*stop)) if stop else tokens


def count_of(tokens: Column, word: str) -> Column:
    """How often the array has the word."""
    return F.size(F.filter(tokens, lambda x: x == word))


def ngram_tokens(text: Column) -> Column:
    """Lower case, without other characters than letters up to U+017E and digits."""
    return _split(F.regexp_replace(F.lower(text), "(?U)[^a-zá-žÁ-Ž0-9\\s]", ""))


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{_WORD}]+"), F.lit(0))


def index_tokens(text: Column, stop: Sequence[str] = INDEX_STOP) -> Column:
    """Word runs made of Latin and Czech letters alone, of two or more, no stop words."""
    run = f"(?<![{_WORD}])[a-z{CZECH_LETTERS}]{{2,}}+(?![{_WORD}])"
    return without(F.regexp_extract_all(F.lower(text), F.lit(run), F.lit(0)), stop)


def tfidf_tokens(text: Column, stop: Sequence[str] = STOP_CS) -> Column:
    """Lower case, punctuation deleted, cut at white space, no stop words."""
    return without(_split(F.translate(F.lower(text), PUNCTUATION, "")), stop)


def cbow_tokens(text: Column, stop: Sequence[str] = STOP_CS) -> Column:
    """Lower case, only Latin and Czech letters and digits left, no stop words."""
    return without(_split(F.regexp_replace(F.lower(text), f"(?U)[^a-z{CZECH_LETTERS}0-9\\s]", "")), stop)


def snippet(text: Column, n: int = 80) -> Column:
    """The first n characters on one line, with dots if there are more."""
    return F.concat(F.replace(F.left(text, F.lit(n)), F.lit("\n"), F.lit(" ")), F.when(F.length(text) > n, "...").otherwise(""))


def ngrams(tokens: Column, n: int) -> Column:
    """array<struct<prefix, next, pos>>: every run of n tokens as its first n - 1
    (joined by a blank; '' for single tokens) and its last."""
    last = F.size(tokens) - (n - 1)
    gram = lambda i: F.struct(F.array_join(F.slice(tokens, i, n - 1), " ").alias("prefix") if n > 1 else F.lit("").alias("prefix"), F.get(tokens, i + (n - 2)).alias("next"), (i - 1).cast("long").alias("pos"))
    # sequence(1, 0) counts down, hence the guard
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), gram)).otherwise(F.array().cast("array<struct<prefix:string,next:string,pos:bigint>>"))


def edit_variants(word: Column, alphabet: str = EDIT_ALPHABET) -> Column:
    """The word and everything one insertion, deletion, replacement or swap of
    neighbours away, without repeats."""
    letters = F.array(*[F.lit(c) for c in dict.fromkeys(alphabet)])
    n = F.length(word)
    head = lambda i: F.substring(word, F.lit(1), i)
    tail = lambda i: F.substring(word, i + 1, n)
    gaps, places = F.sequence(F.lit(0), n), F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    inserted = F.flatten(F.transform(gaps, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i)))))
    dropped = F.when(n > 0, F.transform(places, lambda i: F.concat(head(i), tail(i + 1)))).otherwise(none)
    changed = F.when(n > 0, F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i + 1)))))).otherwise(none)
    pairs = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    swapped = F.when(n > 1, F.transform(pairs, lambda i: F.concat(head(i), F.substring(word, i + 2, F.lit(1)), F.substring(word, i + 1, F.lit(1)), tail(i + 2)))).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), inserted, dropped, changed, swapped))


def char_bigrams(word: Column) -> Column:
    """The pairs of neighbouring characters, in order."""
    n = F.length(word)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def first_position(doc_id: Column, pos: Column) -> Column:
    """One long that orders places of the corpus: documents of up to 2^24 tokens, ids
    within 2^39 of 0; beyond that an error, not a wrong order.  A struct here would
    force a sort-based aggregation."""
    wide = (F.abs(doc_id) >= 1 << 39) | (pos >= 1 << 24)
    place = F.shiftleft(doc_id.cast("long"), 24).bitwiseOR(pos.cast("long"))
    return F.when(wide, F.raise_error(F.lit("places are told apart in order for ids within 2^39 of 0 and texts of up to 2^24 tokens")).cast("long")).otherwise(place)


def lookup(pairs: Sequence[tuple], parts: int = 256):
    """A function from a string Column to the value of that key in the pairs (all of a
    bounded number, carried in the plan), null for others.  A map is searched from end
    to end, so the keys are dealt to small ones by their checksum."""
    if not pairs:
        return lambda x: F.lit(None)
    parts = min(parts, len(pairs))
    dealt: list[list] = [[] for _ in range(parts)]
    for k, v in pairs:
        dealt[zlib.crc32(k.encode()) % parts] += [F.lit(k), F.lit(v)]
    blank = [F.lit(""), F.lit(pairs[0][1])]  # a part without keys; "" is no word
    table = F.array(*[F.create_map(*(d or blank)) for d in dealt])
    return lambda x: F.when(x != "", F.try_element_at(F.get(table, (F.crc32(x.cast("binary")) % parts).cast("int")), x))


def pad_or_cut(ids: Column, n: int, pad: int = 0) -> Column:
    """The ids at a length of n: cut, or filled up with the pad id."""
    return F.concat(F.slice(ids, 1, n), F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(ids), F.lit(0))))


def shift_right(labels: Column, start: int = 0) -> Column:
    """Decoder inputs: the start id and all labels but the last."""
    return F.concat(F.array(F.lit(start)), F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))))


def encode_batch(tokens: Column, find, n: int, prefix: Sequence[str] = (), unknown: int = 1, pad: int = 0) -> Column:
    """struct<ids, mask> of a list of tokens by find, a function from words to ids like
    lookup()'s: after the prefix's words, cut or filled up to n; the mask is 1 where
    there is a token."""
    words = F.concat(F.array(*[F.lit(p) for p in prefix]).cast("array<string>"), tokens)
    coded = F.transform(words, lambda w: F.coalesce(find(w), F.lit(unknown)))
    full = pad_or_cut(coded, n, pad)
    return F.struct(full.alias("ids"), F.transform(full, lambda _, i: (i < F.size(coded)).cast("int")).alias("mask"))
