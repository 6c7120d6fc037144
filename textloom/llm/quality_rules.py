"""Quality rules with thresholds that follow the corpus.

Base measures of each text are taken in one pass.  The method's verdict compares
four rates of a text with fences learned from its own kind: mergeable KLL
quantile sketches of each rate per (lang, source) and per lang give the
quartiles, a text fails where a rate lies beyond `reach` interquartile ranges
from them, and a floor of the fence's width keeps groups of equal texts from
rejecting small differences.  Groups with fewer than `least` texts use the
fences of their language, and languages with fewer use those of all texts.
Sketches are built with map-side combination, so a source with a third of all
rows is no burden, and each has a bounded size whatever its group's.

Rates: characters per word, symbols per character, repeated lines per line,
words in repeated windows per word (log scale for none).  The last three are
only bounded above.

Defined results: a null or empty text has no words and fails the base; a null
lang or source is a group of its own; a repeated row counts as often as it
stands; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np

from .common import WordHash, hashed_words, prepare, rolling, slices, starts_within, text_bytes

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
#: rate: (floor of the interquartile range, bounded below too).  At a reach of 4 the
#: floor of repeat_rate lets a fence lie well below the 30 % at which the base fails.
RATES = {"word_len": (0.5, True), "symbol_rate": (0.01, False), "dup_line_rate": (0.05, False), "repeat_rate": (0.04, False)}


def repeated_words(h: np.ndarray, ends: np.ndarray, n: int = 8) -> np.ndarray:
    """Per text the words covered by windows of n words that it has twice or more."""
    texts = len(ends) - 1
    sizes = np.diff(ends)
    found = np.zeros(texts, np.int64)
    if len(h) < n:
        return found
    owner = np.repeat(np.arange(texts, dtype=np.uint64), sizes)
    ok = np.flatnonzero(starts_within(ends, n, len(h)))
    if not len(ok):
        return found
    from .common import mix

    g = rolling(h, n)[ok] ^ mix(owner[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= s[1:] == s[:-1]
    at = ok[order[same]]
    if len(at):
        delta = np.zeros(len(h) + 1, np.int32)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + n, -1)
        covered = np.cumsum(delta[:-1]) > 0
        found = np.bincount(owner[covered].astype(np.int64), minlength=texts)
    return found


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and all lines with a word."""
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0, int(bool(text.strip(_SPACES)))
    full = [x for x in lines if x.strip(_SPACES)]
    return len(full) - len(set(full)), len(full)


def measure(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the base measures of every whole text, in one pass."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        memory = WordHash()
        for rb in batches:
            raw = rb.column(len(keys)).to_pylist()
            for a, b in slices(raw):
                texts = raw[a:b]
                h, ends = hashed_words(texts, memory)
                plain = [t.translate(None, _SPACES) for t in texts]
                chars = [len(t.decode("utf-8", "replace")) for t in plain]
                symbols = [len(t) - len(t.translate(None, _SYMBOLS)) for t in plain]
                lines = [_dup_lines(t) for t in texts]
                got = [np.diff(ends), chars, symbols, [x[0] for x in lines], repeated_words(h, ends), [x[1] for x in lines]]
                yield pa.RecordBatch.from_arrays([rb.column(i).slice(a, b - a) for i in range(len(keys))] + [pa.array(x, pa.int64()) for x in got], names=[*keys, *names])

    return docs.select(*[docs[k] for k in keys], text_bytes(docs).alias("_text")).mapInArrow(run, f"{schema}, " + ", ".join(f"{n} long" for n in names))


def _rates():
    words = F.greatest("n_words", F.lit(1))
    return {
        "word_len": F.col("word_chars") / words,
        "symbol_rate": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "dup_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words,
    }


def fences(measured: DataFrame, group: list[str], k: int = 200) -> DataFrame:
    """Per group (and per prefix of it, down to all rows) the number of texts and
    the quartiles of each rate, from merged sketches."""
    rated = measured.where(~F.col("base_failed")).select(*group, *[v.alias(n) for n, v in _rates().items()])
    finest = rated.groupBy(*group).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(n, k).alias(n) for n in RATES])
    return finest


def _quartiles(sketched: DataFrame, tag: str) -> DataFrame:
    cols = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(n, F.array(F.lit(0.25), F.lit(0.75)))).alias(f"{tag}_{n}") for n in RATES]
    return sketched.select(*[c for c in sketched.columns if c not in RATES and c != "n"], F.col("n").alias(f"{tag}_n"), *cols)


def apply_rules(docs: DataFrame, id_column: str = "doc_id", least: int = 30, reach: float = 4.0, k: int = 200, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Per row of docs the base measures, base_failed, kept, and `failed`, the
    rates beyond their fences."""
    from .common import materialize

    group = ["lang", "source"]
    base = measure(docs, [id_column, *group]).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    base = materialize(base)
    fine = fences(base, group, k)
    merged = lambda df, by: df.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(n, k).alias(n) for n in RATES])
    by_lang = merged(fine, ["lang"])
    overall = merged(by_lang, [])
    out = base
    for side, tag, keys in ((fine, "f", group), (by_lang, "l", ["lang"]), (overall, "a", [])):
        side = _quartiles(side, tag)
        if not keys:
            out = out.crossJoin(F.broadcast(side))  # one row
            continue
        side = side.select([F.col(c).alias(f"{tag}_{c}") if c in keys else F.col(c) for c in side.columns])
        cond = out[keys[0]].eqNullSafe(side[f"{tag}_{keys[0]}"])
        for c in keys[1:]:
            cond = cond & out[c].eqNullSafe(side[f"{tag}_{c}"])
        out = out.join(side, cond, "left")
    failed = []
    for name, (floor, both) in RATES.items():
        q = F.when(F.col("f_n") >= least, F.col(f"f_{name}")).when(F.col("l_n") >= least, F.col(f"l_{name}")).otherwise(F.col(f"a_{name}"))
        width = reach * F.greatest(q[1] - q[0], F.lit(floor))
        rate = _rates()[name]
        beyond = rate > q[1] + width
        if both:
            beyond = beyond | (rate < q[0] - width)
        failed.append(F.when(beyond, F.lit(name)))
    out = out.withColumn("failed", F.array_compact(F.array(*failed)))
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return out.select(id_column, *group, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "failed")
