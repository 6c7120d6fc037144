"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with white space as single
blanks.  An item of m characters has an error budget k (about a sixteenth of m)
and is split into k + 1 pieces of at least 16 characters: whatever k edits do, one
piece is left whole.  One automaton finds every exact piece hit in a whole text;
each hit names the place where its item would lie, and Myers' bit-parallel
distance over that place decides.  The test items are a stated query set: they
are read in blocks of bounded size, each block is one pass over the documents,
and documents are never shuffled.

An item with no budget (under 32 characters) is one piece: it counts where it
stands word for word, not inside a longer word, and its first such place is given.

Defined results: null or empty texts match nothing; items that are null or have
no characters are not looked for, nor those shorter than `least` (the registered
queries look for all: they pass 1); equal items each give their row; a repeated document gives repeated rows;
an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_bytes

_ODD = re.compile(r"[^\S ]|  ")
#: Thai, Lao, Burmese, Khmer, kana, Han: written without blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalise(text: str) -> str:
    t = text.lower().replace("\n", " ")
    return " ".join(t.split()) if _ODD.search(t) else t.strip(" ")


def budget(m: int, piece: int = 16) -> int:
    return max(0, m // piece - 1)


#: Items under so many characters have no budget.
_SHORT = 32


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item in k + 1 runs of nearly equal length, with where they start."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _inside(a: str, b: str) -> bool:
    """Whether neighbouring characters a, b are of one word."""
    if unicodedata.category(b)[0] == "M":
        return True
    return all((c == "_" or unicodedata.category(c)[0] in "LMN") and not _UNSPACED.match(c) for c in (a, b))


def whole_words(text: str, a: int, b: int) -> bool:
    """Whether no word of the text goes on over either end of text[a:b]."""
    return not (a > 0 and _inside(text[a - 1], text[a]) or b < len(text) and _inside(text[b - 1], text[b]))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any run of the text, and the
    first place where such a run ends (-1: the empty run at the start)."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, where = m, -1
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere: no carry in
        mh = mh << 1 & full
        xv = e | mv
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, where = score, j
    return best, where


class Matcher:
    """Finds the items of one block: a list of (item ids, normalised text)."""

    def __init__(self, items: list[tuple[list[int], str]]):
        self.items, self.automaton = items, None

    def __getstate__(self):
        return {"items": self.items, "automaton": None}

    def build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int, bool]]] = {}
        for n, (_, item) in enumerate(self.items):
            short = len(item) < _SHORT
            for start, piece in pieces(item, budget(len(item))):
                at.setdefault(piece, []).append((n, start + len(piece), short))
        for piece, places in at.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[list[int], int, int, int]]:
        """(item ids, distance, first and one past the last place in the
        normalised text that was searched for it): the best of each item."""
        if self.automaton is None:
            self.build()
        text = normalise(text)
        spots: dict[int, list[int]] = {}
        exact: dict[int, int] = {}
        for end, places in self.automaton.iter(text):
            for n, done, short in places:
                if not short:
                    spots.setdefault(n, []).append(end + 1 - done)
                elif n not in exact and whole_words(text, end + 1 - done, end + 1):
                    exact[n] = end + 1 - done
        found = [(self.items[n][0], 0, a, a + len(self.items[n][1])) for n, a in exact.items()]
        for n, starts in spots.items():
            ids, item = self.items[n]
            k, m = budget(len(item)), len(item)
            best = None
            starts.sort()
            i = 0
            while i < len(starts):
                j = i
                while j + 1 < len(starts) and starts[j + 1] - starts[i] <= 2 * k + 1:
                    j += 1
                a, b = max(0, starts[i] - k), starts[j] + m + k
                d, end = myers(item, text[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = (d, max(a, a + end + 1 - m - d), a + end + 1)
                i = j + 1
            if best:
                found.append((ids, *best))
        return found


def item_blocks(benchmark: DataFrame, id_column: str = "item_id", least: int = 32, block_chars: int = 8_000_000) -> Iterator[Matcher]:
    """The items in blocks of at most so many characters (or one item)."""
    held: dict[str, list[int]] = {}
    size = 0
    for r in benchmark.select(id_column, "text").toLocalIterator():
        item = normalise(r[1] or "")
        if len(item) < max(least, 1):
            continue
        if size + len(item) > block_chars and held:
            yield Matcher([(ids, t) for t, ids in held.items()])
            held, size = {}, 0
        if item not in held:
            size += len(item)
        held.setdefault(item, []).append(r[0])
    if held:
        yield Matcher([(ids, t) for t, ids in held.items()])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", least: int = 32) -> DataFrame:
    """A row for each document and item found in it: the ids, distance, and the
    span in the normalised text."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(docs[id_column], text_bytes(docs).alias("_text"))
    schema = f"`{id_column}` {kind}, item_id long, distance int, span_start int, span_end int"

    def passing(block):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # of at most block_chars

        def run(batches):
            matcher = shared.value
            for rb in batches:
                rows = [(i, item, d, a, b) for i, t in enumerate(rb.column(1).to_pylist()) for ids, d, a, b in matcher.find(t.decode("utf-8", "replace")) for item in ids]
                of, *rest = zip(*rows, strict=True) if rows else ([], [], [], [], [])
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(of, pa.int64())), *(pa.array(list(x), k) for x, k in zip(rest, kinds, strict=True))], names=[id_column, "item_id", "distance", "span_start", "span_end"])

        return source.mapInArrow(run, schema)

    out = None
    for matcher in item_blocks(benchmark, least=least):
        out = passing(matcher) if out is None else out.unionAll(passing(matcher))
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 32) -> DataFrame:
    """The documents in which no item is found, all columns as they are."""
    prepare(docs.sparkSession)

    def clean(block):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # of at most block_chars

        @F.pandas_udf("boolean")
        def found_nothing(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = shared.value
            for s in texts:
                yield pd.Series([not matcher.find(t) if t else True for t in s], dtype=bool)

        return found_nothing

    for matcher in item_blocks(benchmark, least=least):
        docs = docs.where(clean(matcher)(docs["text"]))
    return docs
