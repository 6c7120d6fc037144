"""Exact search of a pattern in texts: positions, and the character comparisons
that brute force, Knuth-Morris-Pratt and Horspool would need.

Texts without the pattern are told apart in the JVM.  Positions and counts need a
walk along the text, so they run in Arrow batches, in linear time but for brute
force, whose count takes a vector step per pattern character.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counting import frugal

METHODS = ("brute_force", "kmp", "horspool")


def positions(text: str, pattern: str) -> list[int]:
    """All places, overlapping ones too."""
    out, at = [], text.find(pattern)
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


def apart(places: list[int], m: int) -> list[int]:
    """The leftmost places that do not overlap."""
    out, free = [], 0
    for p in places:
        if p >= free:
            out.append(p)
            free = p + m
    return out


def brute_force_comparisons(text: str, pattern: str) -> int:
    """Every alignment is compared from the left up to its first difference."""
    t = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.arange(max(0, len(t) - len(pattern) + 1))
    total = 0
    for j, c in enumerate(pattern):
        total += len(starts)
        starts = starts[t[starts + j] == ord(c)]
    return total


class KmpCost:
    """KMP as an automaton whose edges carry comparison counts.

    A character that a state expects costs one.  In a state just entered by a
    match it was looked at beforehand, so a mismatch there costs one and hands the
    character to the border state; anywhere else a mismatch costs two.
    """

    def __init__(self, pattern: str):
        m = len(pattern)
        border = [0] * (m + 1)
        for q in range(2, m + 1):
            k = border[q - 1]
            while k and pattern[k] != pattern[q - 1]:
                k = border[k]
            border[q] = k + (pattern[k] == pattern[q - 1])
        self.m, self.restart = m, border[m]
        letters = set(pattern)
        # per state: character -> (next state, cost); None stands for other characters
        self.cold: list[dict] = []
        self.warm: list[dict] = []
        for j in range(m):
            cold, warm = {}, {}
            for c in (*letters, None):
                if c == pattern[j]:
                    cold[c] = warm[c] = (j + 1, 1)
                else:
                    to, cost = self.cold[border[j]][c] if j else (0, 0)
                    cold[c], warm[c] = (to, cost + 2), (to, cost + 1)
            self.cold.append(cold)
            self.warm.append(warm)

    def comparisons(self, text: str) -> int:
        state, table, total = 0, self.cold[0], 0
        for c in text:
            state, cost = table[c] if c in table else table[None]
            total += cost
            if state == self.m:
                state = self.restart
                table = self.cold[state]
            else:
                table = self.warm[state] if state else self.cold[0]
        return total


def horspool_comparisons(text: str, pattern: str) -> int:
    """Alignments compared from the right; a hit moves on by the pattern's length,
    anything else to the last place that fits the alignment's last character."""
    m, n = len(pattern), len(text)
    move = dict(zip(pattern[:-1], range(m - 1, 0, -1), strict=True))
    back = pattern[::-1]
    total, end = 0, m
    while end <= n:
        agree = next((k for k in range(m) if text[end - 1 - k] != back[k]), m)
        total += min(agree + 1, m)
        end += m if agree == m else move.get(text[end - 1], m)
    return total


def chosen_method(text: Column, pattern: Column) -> Column:
    """Which algorithm suits the sizes: KMP for patterns of over half the text,
    Horspool for short ones of over three different characters, else brute force."""
    different = F.size(F.array_distinct(F.filter(F.split(pattern, ""), lambda x: x != "")))
    return F.when(F.length(pattern) > F.floor(F.length(text) / 2), "kmp").when((F.length(pattern) <= 5) & (different > 3), "horspool").otherwise("brute_force")


def _checked(pattern: str) -> str:
    if not pattern:
        raise ValueError("an empty pattern is everywhere")
    return pattern


def _parts(batches, rows: int = 250):
    """The batches in few rows each: texts as Python strings take several times their
    bytes, and only those of one part are held."""
    for rb in batches:
        for a in range(0, rb.num_rows, rows):
            yield rb.slice(a, rows)


def search(docs: DataFrame, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, positions, apart_positions (0-based, in code points) of every text that
    has the pattern.  Null texts have none."""
    import pyarrow as pa

    _checked(pattern)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for rb in _parts(batches):
            found = [positions(t, pattern) for t in rb.column(1).to_pylist()]
            every = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rb.column(0), every, pa.array([apart(p, len(pattern)) for p in found], every.type)], names=[id_column, "positions", "apart_positions"])

    with_it = docs.where(docs[text_column].contains(pattern)).select(docs[id_column], docs[text_column])
    return with_it.mapInArrow(frugal(run), f"`{id_column}` {kind}, positions array<int>, apart_positions array<int>")


def comparisons(docs: DataFrame, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and the comparisons of each method, and of the one that is chosen, on
    every text."""
    import pyarrow as pa

    _checked(pattern)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        kmp = KmpCost(pattern)
        for rb in _parts(batches):
            texts = rb.column(1).to_pylist()
            counts = [[brute_force_comparisons(t, pattern) for t in texts], [kmp.comparisons(t) for t in texts], [horspool_comparisons(t, pattern) for t in texts]]
            yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(c, pa.int64()) for c in counts), rb.column(2)], names=[id_column, *METHODS, "method"])

    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(docs[id_column], text.alias("text"), chosen_method(text, F.lit(pattern)).alias("method"))
    out = rows.mapInArrow(frugal(run), f"`{id_column}` {kind}, " + ", ".join(f"{m} long" for m in METHODS) + ", method string")
    hybrid = F.when(F.col("method") == "kmp", F.col("kmp")).when(F.col("method") == "horspool", F.col("horspool")).otherwise(F.col("brute_force"))
    return out.withColumn("hybrid", hybrid)


def harness(spark, cases: dict[str, tuple[str, str]]) -> DataFrame:
    """name, the comparisons of each method, method and hybrid for cases of a text and
    its pattern: one pass per pattern."""
    out = None
    for name, (text, pattern) in cases.items():
        own = comparisons(spark.createDataFrame([(name, text)], "name string, text string"), pattern, "name")
        out = own if out is None else out.unionAll(own)
    return out
