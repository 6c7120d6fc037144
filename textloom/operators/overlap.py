"""Overlap of texts with references: precision, recall and F1 of word n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import stemmed
from .counting import frugal


def overlap_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def stemmed_tokens(text: Column) -> Column:
    """The same as English stems."""
    return stemmed(overlap_tokens(text))


def dialogue_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, reference (a user's turn), prediction (the assistant's next turn)."""
    a = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    b = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "reference", "prediction")


def scores(pairs: DataFrame, keys: list[str], n: int = 1, tokens=overlap_tokens) -> DataFrame:
    """keys, precision, recall, f1 of each pair(reference, prediction) whose texts
    are not blank.  A pair without n-grams on a side has 0.

    Both sides of a pair are counted where the pair is; nothing is shuffled."""
    return scores_of(pairs, keys, (n,), tokens).select(*keys, *[F.col(f"{c}_{n}").alias(c) for c in MEASURES])


MEASURES = ("precision", "recall", "f1")


def scores_of(pairs: DataFrame, keys: list[str], sizes: tuple[int, ...] = (1, 2), tokens=overlap_tokens) -> DataFrame:
    """keys, and precision_n, recall_n, f1_n of scores() for each n of sizes, in one pass."""
    import pyarrow as pa

    rows = pairs.where((F.trim("reference") != "") & (F.trim("prediction") != ""))
    rows = rows.select(*keys, tokens(F.col("reference")).alias("reference"), tokens(F.col("prediction")).alias("prediction"))
    at = len(keys)

    def run(batches):
        for rb in batches:
            for a in range(0, rb.num_rows, 1000):
                part = rb.slice(a, 1000)
                out = [part.column(i) for i in range(at)]
                for n in sizes:
                    out += map(pa.array, _measures(part.column(at), part.column(at + 1), n))
                yield pa.RecordBatch.from_arrays(out, names=[*keys, *(f"{c}_{n}" for n in sizes for c in MEASURES)])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys]
    return rows.mapInArrow(frugal(run), ", ".join([*kinds, *(f"{c}_{n} double" for n in sizes for c in MEASURES)]))


def _measures(reference, prediction, n: int) -> tuple:
    """Precision, recall and F1 of n-grams of two columns of token lists, row by row."""
    import pyarrow as pa

    rows = len(reference)
    words = pa.concat_arrays([reference.flatten(), prediction.flatten()]).dictionary_encode()
    codes, wide = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    sizes = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (reference, prediction)]).astype(np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    starts = np.flatnonzero(left >= n)
    key = np.repeat(np.arange(2 * rows) % rows, sizes)[starts]  # the pair's row, then token after token
    for i in range(n):
        if int(key.max(initial=0)) >= (1 << 62) // wide:
            key = np.unique(key, return_inverse=True)[1]
        key = key * wide + codes[starts + i]
    owner = np.repeat(np.arange(2 * rows), sizes)[starts]
    total = np.bincount(owner, minlength=2 * rows)
    (kr, cr), (kp, cp) = (np.unique(key[side], return_counts=True) for side in (owner < rows, owner >= rows))
    _, ir, ip = np.intersect1d(kr, kp, assume_unique=True, return_indices=True)
    row_of = np.zeros(len(kr), np.int64)
    row_of[np.searchsorted(kr, key[owner < rows])] = owner[owner < rows]
    both = np.bincount(row_of[ir], np.minimum(cr[ir], cp[ip]), rows)
    share = lambda d: np.divide(both, d, out=np.zeros(rows), where=d > 0)
    p, r = share(total[rows:]), share(total[:rows])
    return p, r, np.divide(2 * p * r, p + r, out=np.zeros(rows), where=p + r > 0)


def mean_f1(pairs: DataFrame, keys: list[str], tokens=overlap_tokens) -> DataFrame:
    """f1_1, f1_2: mean F1 of single words and word pairs; 0 without a pair."""
    one, two = (scores(pairs, keys, n, tokens).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias(f"f1_{n}")) for n in (1, 2))
    return one.crossJoin(two)  # one row each


def first_pairs(pairs: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """The evaluation subset: the first pairs by their keys."""
    return pairs.orderBy(*keys).limit(most)
