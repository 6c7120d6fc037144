"""Counts of tokens within documents, made in Arrow slices of bounded size.

A document is whole in one row, so its own counts need no shuffle; what a slice has in
common is counted once for the slice."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a slice, or one document.
SLICE = 1 << 19


def frugal(run):
    """run(batches), giving back at its end what it has freed: a worker lives on for the
    next tasks."""

    def kept(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return kept


def slices(rb, column: int = 1, most: int = SLICE):
    """The batch in runs of rows with at most `most` list elements, or one row."""
    ends = rb.column(column).offsets.to_numpy()[1:].astype(np.int64)
    at, n = 0, rb.num_rows
    while at < n:
        start = int(ends[at - 1]) if at else int(rb.column(column).offsets[0].as_py())
        to = max(at + 1, int(np.searchsorted(ends, start + most, "right")))
        yield rb.slice(at, to - at)
        at = to


def coded(lists) -> tuple:
    """(codes, the words behind them, sizes) of a list column; null lists are empty."""
    words = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return words.indices.to_numpy().astype(np.int64), words.dictionary, sizes


def own_counts(part) -> tuple:
    """(row, code, count, words, sizes) of each row's different tokens, by row."""
    codes, words, sizes = coded(part.column(1))
    wide = max(1, len(words))
    keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * wide + codes, return_counts=True)
    return keys // wide, keys % wide, counts, words, sizes


def document_counts(docs: DataFrame, tokens: Column, id_column: str = "doc_id") -> DataFrame:
    """id, term, cnt, n (the document's tokens) of every term of a document."""
    import pyarrow as pa

    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for rb in batches:
            for part in slices(rb):
                row, code, counts, words, sizes = own_counts(part)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), words.take(pa.array(code)), pa.array(counts), pa.array(sizes[row])], names=[id_column, "term", "cnt", "n"])

    return docs.select(docs[id_column], tokens.alias("t")).mapInArrow(frugal(run), f"`{id_column}` {kind}, term string, cnt long, n long")


def document_frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    """term, df, summed up by slices before the shuffle."""
    import pyarrow as pa

    def run(batches):
        for rb in batches:
            for part in slices(rb):
                _, code, _, words, _ = own_counts(part)
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(code, minlength=len(words)))], names=["term", "df"])

    return docs.select(F.lit(0).alias("i"), tokens.alias("t")).mapInArrow(frugal(run), "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def posting_slices(docs: DataFrame, tokens: Column, segment: int, shift: int = 1) -> DataFrame:
    """term, seg, ids: of each slice and term the raised ids in order, cut where they
    pass multiples of `segment`; one row where plain postings have one for each id."""
    import pyarrow as pa

    def run(batches):
        for rb in batches:
            for part in slices(rb):
                row, code, _, words, _ = own_counts(part)
                ids = part.column(0).to_numpy(zero_copy_only=False)[row].astype(np.int64) + shift
                order = np.lexsort((ids, code))
                ids, code = ids[order], code[order]
                seg = ids // segment
                first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(seg, prepend=-1) != 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(code[first])), pa.array(seg[first]), lists], names=["term", "seg", "ids"])

    return docs.where(docs["doc_id"].isNotNull()).select("doc_id", tokens.alias("t")).mapInArrow(frugal(run), "term string, seg long, ids array<long>")


def merged(slices: DataFrame, finish, schema: str, starts: DataFrame | None = None) -> DataFrame:
    """finish(terms, seg, before, ids, offsets) -> record batches, over the whole sorted
    list of each (term, seg), without repeats; `starts` (term, seg, before) tells what
    stands before a segment, else 0.

    The rows of one key are neighbours after one shuffle and a sort, so a task holds a
    batch and one list."""
    import pyarrow as pa

    rows = slices.select("term", "seg", "ids", F.lit(0).cast("long").alias("before"))
    if starts is not None:
        rows = rows.unionAll(starts.select("term", "seg", F.array().cast("array<bigint>").alias("ids"), "before"))
    rows = rows.repartition("term", "seg").sortWithinPartitions("term", "seg")

    def groups(rb):
        code, seg = rb.column(0).dictionary_encode().indices.to_numpy(), rb.column(1).to_numpy()
        return np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(seg, prepend=seg[0]) != 0))

    def done(rb, first):
        rows_of = np.diff(first, append=rb.num_rows)
        lists = rb.column(2)
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        owner = np.repeat(np.repeat(np.arange(len(first)), rows_of), sizes)
        ids = lists.flatten().to_numpy()
        order = np.lexsort((ids, owner))
        ids, owner = ids[order], owner[order]
        new = (np.diff(ids, prepend=0) != 0) | (np.diff(owner, prepend=-1) != 0)
        ids, owner = ids[new], owner[new]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first)))])
        at = pa.array(first)
        before = np.maximum.reduceat(rb.column(3).to_numpy(), first)
        return finish(rb.column(0).take(at), rb.column(1).to_numpy()[first], before, ids, offsets)

    def run(batches):
        rest = None
        for rb in batches:
            if not rb.num_rows:
                continue
            for a in range(0, rb.num_rows, 2000):
                part = rb.slice(a, 2000)
                if rest is not None:
                    part = pa.Table.from_batches([rest, part]).combine_chunks().to_batches()[0]
                first = groups(part)
                if len(first) > 1:
                    yield from done(part.slice(0, first[-1]), first[:-1])
                rest = part.slice(first[-1])
        if rest is not None:
            yield from done(rest, np.zeros(1, np.int64))

    return rows.mapInArrow(frugal(run), schema)


class Best:
    """The best k (id, similarity) of each of n queries, of similarities above `least`,
    ties to the smaller id.  What may be among them is gathered, and judged when there
    is enough of it."""

    def __init__(self, n: int, k: int, least: float = 0.0, most: int = 1 << 20):
        self.n, self.k, self.least, self.most = n, k, least, most
        self.floor = np.full(n, least)  # the k-th best so far
        self.kept = (np.zeros(0, np.int64), None, np.zeros(0))
        self.new, self.size = [], 0

    def offer(self, ids: np.ndarray, sims: np.ndarray) -> None:
        """A row of similarities with all queries for each id."""
        row, q = np.nonzero((sims >= self.floor) & (sims > self.least))
        if len(row):
            self.new.append((q, ids[row], sims[row, q]))
            self.size += len(row)
            if self.size > self.most:
                self.judge()

    def judge(self) -> None:
        parts = [x for x in (self.kept, *self.new) if x[1] is not None]
        if not parts:
            self.kept = (self.kept[0], np.zeros(0, np.int64), self.kept[2])
            return
        q, ids, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
        place_of = ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((place_of, -sims, q))
        q, ids, sims = q[order], ids[order], sims[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.kept = tuple(x[place < self.k] for x in (q, ids, sims))
        last = place == self.k - 1
        self.floor[q[last]] = sims[last]
        self.new, self.size = [], 0
