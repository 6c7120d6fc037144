"""N-grams of whole slices of documents: counts, counts of some, and the sums of log
probabilities of documents under the model of their own corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counting import coded, frugal, slices

#: Tokens of a slice: the more, the fewer rows of one n-gram go out.
WIDE = 1 << 20


class Slice:
    """The tokens of a slice's documents, by their ids: code of each, its place, and the
    tokens from there to the document's end."""

    def __init__(self, part):
        import pyarrow as pa

        ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.codes, self.words, self.sizes = coded(part.column(1).take(pa.array(order)))
        ends = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.arange(len(self.codes))
        self.pos = at - np.repeat(ends - self.sizes, self.sizes)
        self.left = np.repeat(ends, self.sizes) - at

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.left >= n)

    def keys(self, starts: np.ndarray, n: int) -> np.ndarray:
        """A number for each n-gram, the same for the same one."""
        key, wide = self.codes[starts], max(1, len(self.words))
        for i in range(1, n):
            if int(key.max(initial=0)) >= (1 << 62) // wide:
                key = np.unique(key, return_inverse=True)[1]
            key = key * wide + self.codes[starts + i]
        return key

    def text(self, starts: np.ndarray, n: int):
        """The n-grams at some starts, joined by blanks."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not n:
            return pa.array([""] * len(starts), pa.string())
        words = [self.words.take(pa.array(self.codes[starts + i])) for i in range(n)]
        return words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")

    def hashes(self, n: int) -> tuple:
        """Two hashes (64 and 31 bits) of the n-gram at each start of n tokens."""
        import pandas as pd

        from .tfidf import _mixed

        names, starts = self.words.to_numpy(zero_copy_only=False), self.starts(n)
        out = []
        for salt in ("first of n-grams", "other of n-grams"):
            own = pd.util.hash_array(names, hash_key=salt, categorize=False) if len(names) else np.zeros(0, np.uint64)
            h = np.full(len(starts), n, np.uint64)
            for i in range(n):
                h = _mixed(h * np.uint64(0x100000001B3) + own[self.codes[starts + i]], i + 1)
            out.append(h)
        return out[0], (out[1] >> np.uint64(33)).astype(np.uint32)


def _of_slices(docs: DataFrame, tokens: Column, each, schema: str) -> DataFrame:
    def run(batches):
        for rb in batches:
            for part in slices(rb, most=WIDE):
                own = Slice(part)
                if len(own.codes):
                    yield from each(own)

    return docs.where(docs["doc_id"].isNotNull()).select("doc_id", tokens.alias("t")).mapInArrow(frugal(run), schema)


def counts(docs: DataFrame, n: int, tokens: Column, tails: bool = False) -> DataFrame:
    """prefix, next, cnt, doc_id, pos (where it stands first) of each slice's n-grams.
    tails: the last n - 1 tokens of each document too, as a prefix with no next."""
    import pyarrow as pa

    def rows(own, starts, m):
        _, first, cnt = np.unique(own.keys(starts, m), return_index=True, return_counts=True)
        first = starts[first]
        last = own.words.take(pa.array(own.codes[first + n - 1])) if m == n else pa.nulls(len(first), pa.string())
        return pa.RecordBatch.from_arrays([own.text(first, n - 1), last, pa.array(cnt), pa.array(own.ids[own.doc[first]]), pa.array(own.pos[first])], names=["prefix", "next", "cnt", "doc_id", "pos"])

    def each(own):
        yield rows(own, own.starts(n), n)
        if tails:
            yield rows(own, np.flatnonzero(own.left == n - 1), n - 1)

    return _of_slices(docs, tokens, each, "prefix string, next string, cnt long, doc_id long, pos long")


def chosen_counts(docs: DataFrame, wanted: list[str], tokens: Column) -> DataFrame:
    """gram, cnt of some n-grams (tokens joined by blanks), a bounded number."""
    import pyarrow as pa
    import pyarrow.compute as pc

    by_length: dict[int, list[str]] = {}
    for g in dict.fromkeys(wanted):
        by_length.setdefault(g.count(" ") + 1, []).append(g)

    def each(own):
        for n, grams in by_length.items():
            at = pc.fill_null(pc.index_in(pa.array([w for g in grams for w in g.split(" ")], pa.string()), value_set=own.words), -1).to_numpy().reshape(-1, n)
            # Codes of the wanted ones alone are few: starts whose tokens are all among theirs.
            starts = own.starts(n)
            for i in range(n):
                have = np.zeros(len(own.words) + 1, bool)
                have[at[:, i]] = True
                starts = starts[have[own.codes[starts + i]]]
            found = pc.value_counts(own.text(starts, n).filter(pc.is_in(own.text(starts, n), value_set=pa.array(grams, pa.string()))))
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["gram", "cnt"])

    return _of_slices(docs, tokens, each, "gram string, cnt long").groupBy("gram").agg(F.sum("cnt").alias("cnt"))


def hashed_counts(docs: DataFrame, n: int, tokens: Column) -> DataFrame:
    """h, cnt: counts by a 64-bit hash, at least those of each n-gram that has it."""
    import pyarrow as pa

    def each(own):
        h, cnt = np.unique(own.hashes(n)[0].view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(cnt)], names=["h", "cnt"])

    return _of_slices(docs, tokens, each, "h long, cnt long").groupBy("h").agg(F.sum("cnt").alias("cnt"))


def counts_by_hash(docs: DataFrame, n: int, hashes: list[int], tokens: Column) -> DataFrame:
    """The rows of counts() whose hash is one of a bounded number."""
    import pyarrow as pa

    wanted = np.array(sorted(hashes), np.int64)

    def each(own):
        starts = own.starts(n)[np.isin(own.hashes(n)[0].view(np.int64), wanted)]
        _, first, cnt = np.unique(own.keys(starts, n), return_index=True, return_counts=True)
        first = starts[first]
        yield pa.RecordBatch.from_arrays([own.text(first, n - 1), own.words.take(pa.array(own.codes[first + n - 1])), pa.array(cnt), pa.array(own.ids[own.doc[first]]), pa.array(own.pos[first])], names=["prefix", "next", "cnt", "doc_id", "pos"])

    return _of_slices(docs, tokens, each, "prefix string, next string, cnt long, doc_id long, pos long")


def _packed(arrays: list[np.ndarray]) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[str(i) for i in range(len(arrays))])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> list[np.ndarray]:
    import pyarrow as pa

    batch = pa.ipc.open_stream(blob).read_next_batch()
    return [c.to_numpy() for c in batch.columns]


def _least(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 up in as few bytes as they need."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def log_sums(docs: DataFrame, n: int, alpha: float, vocabulary: int, tokens: Column) -> DataFrame:
    """doc_id, n_grams, l: how many n-grams a document has, and the sum of the logs of
    their probabilities in the corpus, (count + alpha) / (count of the prefix + alpha *
    vocabulary), or, for single words, (count + alpha) / (alpha * vocabulary or 1).

    The sum is one over the document's n-grams less one over their prefixes.  Each slice
    packs (hash, document, count) of both by buckets of the hash; a bucket has all of an
    n-gram, so its counts are known there, and gives its share of each document's sum.
    N-grams are told apart by 95 bits; buckets are read one after another, in order."""
    import pyarrow as pa

    buckets = min(1 << 15, 16 * max(1, docs.rdd.getNumPartitions()))
    flat = alpha * vocabulary if alpha else 1.0

    def each(own):
        parts = []
        for m in {n, max(1, n - 1)}:
            h, g = own.hashes(m)
            starts = own.starts(m)
            doc = own.doc[starts]
            order = np.lexsort((doc, g, h))
            h, g, doc = h[order], g[order], doc[order]
            new = np.flatnonzero((np.diff(h, prepend=~h[:1]) != 0) | (np.diff(g, prepend=0) != 0) | (np.diff(doc, prepend=-1) != 0))
            k = np.diff(new, append=len(h))
            # As prefixes, n-grams at a document's end do not count.
            inner = k if m == n else np.add.reduceat((own.left[starts] >= n)[order].astype(np.int64), new) if len(new) else k
            parts.append((h[new], g[new] * np.uint32(2) + np.uint32(m == n), own.ids[doc[new]], k, inner))
        h, g, ids, k, inner = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, g, ids, k, inner = h[order], g[order], ids[order], k[order], inner[order]
        base = int(ids.min(initial=0 if not len(ids) else ids[0]))
        at = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        blobs = []
        for a, b in zip(cut, np.append(cut[1:], len(at)), strict=True):
            blobs.append(_packed([np.diff(h[a:b], prepend=np.uint64(0)), g[a:b], _least(ids[a:b] - base), _least(k[a:b]), _least(inner[a:b])]))
        yield pa.RecordBatch.from_arrays([pa.array(at[cut]), pa.array(np.full(len(cut), base)), pa.array(blobs, pa.binary())], names=["bucket", "base", "blob"])

    def judged(blobs, bases):
        h, g, ids, k, inner = (np.concatenate(x) for x in zip(*((np.cumsum(b[0], dtype=np.uint64), b[1], b[2].astype(np.int64) + base, b[3].astype(np.int64), b[4].astype(np.int64)) for b, base in zip(map(_unpacked, blobs), bases, strict=True)), strict=True))
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        first = np.flatnonzero((np.diff(h, prepend=~h[:1]) != 0) | (np.diff(g, prepend=g[0]) != 0))
        total = np.add.reduceat(k[order], first)
        full = (g[first] & np.uint32(1)) == 1
        log = np.where(full, np.log(total + alpha), -np.log(total + alpha * vocabulary))
        if n == 1:
            log -= np.log(flat)
        sizes = np.diff(first, append=len(h))
        l, counted = np.repeat(log, sizes) * inner[order], np.where(np.repeat(full, sizes), inner[order], 0)
        return ids[order], counted, l

    def summed(gathered):
        ids, counted, l = (np.concatenate(x) for x in zip(*gathered, strict=True))
        known, at = np.unique(ids, return_inverse=True)
        return known, np.bincount(at, counted, len(known)).astype(np.int64), np.bincount(at, l, len(known))

    def run(batches):
        held, now, gathered, size = ([], []), None, [], 0

        def flush():
            nonlocal gathered, size
            if held[0]:
                gathered.append(judged(*held))
                size += len(gathered[-1][0])
                held[0].clear()
                held[1].clear()
                if size > 1 << 22:
                    gathered = [summed(gathered)]
                    size = len(gathered[0][0])

        for rb in batches:
            for bucket, base, blob in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True):
                if bucket != now:
                    flush()
                    if size > 1 << 21:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(gathered)], names=["doc_id", "n_grams", "l"])
                        gathered, size = [], 0
                    now = bucket
                held[0].append(blob)
                held[1].append(base)
        flush()
        if gathered:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(gathered)], names=["doc_id", "n_grams", "l"])

    sent = _of_slices(docs, tokens, each, "bucket long, base long, blob binary")
    shares = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(run), "doc_id long, n_grams long, l double")
    return shares.groupBy("doc_id").agg(F.sum("n_grams").alias("n_grams"), F.sum("l").alias("l")).where("n_grams > 0")
