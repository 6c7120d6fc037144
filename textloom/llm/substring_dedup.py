"""Removal of passages of 50 words that an earlier document has.

Every window of 50 words is represented by its *anchor*: the least hash among its
runs of ten words.  Equal windows have equal anchors, and a text has about one
anchor in twenty words, each owning the consecutive windows that it represents.

First pass: each task counts its documents' anchors in a count-min sketch of two
rows; the sketches are merged in a tree and never underestimate in how many documents
a window occurs, which is in at most as many as its anchor.  Counters end at two, all
that is asked of them.  Second pass: anchors estimated to occur once are dropped with
all their windows; the others give one row with their windows' hashes, grouped exactly
by content.  Rows of equal contexts collapse first, so copies cost a row each, and
single windows are compared only where one anchor has several contexts.  No window
that occurs twice is lost, since its anchor's estimate is two at least; the sketch
only decides how much is grouped.

A task's sketch is a list of its cells on the finest grid; once all anchors are
counted, merging folds the grid to 4 to 8 cells an anchor, so the share of anchors let
through for nothing (some 5 in 100) does not follow the input.  The grid ends at 2^28
cells a row, 64 MB of bits in all, which bounds what is broadcast; beyond some 100
million anchors (14 GB of text) it fills up and lets more through, which costs time in
proportion to the input and loses nothing.

Memory: a worker gives what its task took back to the system, and the executors' heaps
are collected before each stage of weight, since a heap that one has grown lacks to the
next (`common.shrink_heaps`).

Defined results: null and empty texts have no words; a document is never compared
with one of the same id; rows with a null id neither remove nor are removed;
repeated rows are treated alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, discard, free_memory, hashed_words, materialize, merge_blocks, mix, odd_multipliers, prepare, shrink_heaps, slices, text_bytes

WINDOW, GRAM = 50, 10
#: Bytes of text whose words a task holds at a time.
SLICE = 2_000_000
SPAN = WINDOW - GRAM + 1  # runs of ten words in a window
#: Bits of a cell's number on the finest and coarsest grid; blocks that a row is merged in.
GRID, LEAST_GRID, BLOCKS = 28, 16, 64
#: Rows of one anchor are dealt to so many tasks where they meet the anchor alone.
SALTS = 16


def anchors(h: np.ndarray, ends: np.ndarray):
    """For all texts' windows: hash of the anchor, text, first window, number of
    windows and place of the anchor, an entry for each run of windows with one."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    m = len(h) - GRAM + 1
    if m < SPAN:
        return none
    g = np.zeros(m, np.uint64)
    for j, c in enumerate(odd_multipliers(GRAM, 31)):
        g += h[j : j + m] * c
    g = mix(g)
    low = np.uint64(28)
    key = (g >> low) << low | np.arange(m, dtype=np.uint64)  # the leftmost of equal ones
    best, width = key, 1
    while width * 2 <= SPAN:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = SPAN - width
    if rest:
        best = np.minimum(best[: len(best) - rest], best[rest:])
    sizes = np.diff(ends)
    fit = sizes - WINDOW + 1
    texts = np.flatnonzero(fit > 0)
    if not len(texts):
        return none
    text = np.repeat(texts, fit[texts])
    start = np.arange(len(text)) - np.repeat(np.cumsum(fit[texts]) - fit[texts], fit[texts]) + ends[text]
    place = (best[start] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(new)
    return g[place[at]], text[at], start[at], np.diff(np.append(at, len(text)))


def window_hashes(h: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of the windows of all the runs, one after another."""
    at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    total = np.zeros(len(at), np.uint64)
    for j, c in enumerate(odd_multipliers(WINDOW, 57)):
        total += h[at + j] * c
    return mix(total).view(np.int64)


def _cells(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Its cell in either row of the finest grid."""
    x = mix(anchor + np.uint64(0x1234567))
    top = np.uint64(64 - GRID)
    return (x >> top).astype(np.int64), (mix(x + np.uint64(0x9E3779B9)) >> top).astype(np.int64)


def _sparse(cells: np.ndarray) -> bytes:
    """Sorted cells, each as often as it was counted, up to two."""
    return b"s" + zlib.compress(np.diff(cells, prepend=0).astype("<u4").tobytes(), 1)


def _bits(blob: bytes, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits of a block's cells counted at least once, and twice."""
    raw = np.frombuffer(zlib.decompress(memoryview(blob)[1:]), "<u4" if blob[:1] == b"s" else np.uint8)
    if blob[:1] == b"d":
        return raw[: len(raw) // 2], raw[len(raw) // 2 :]
    cells = np.cumsum(raw, dtype=np.int64) >> shift
    once, twice = np.zeros((2, (1 << GRID) // BLOCKS >> shift), bool)
    once[cells] = True
    twice[cells[1:][cells[1:] == cells[:-1]]] = True
    return np.packbits(once), np.packbits(twice)


class Sketch:
    """Packed bits of the cells counted twice, of both rows, on a grid folded by shift."""

    def __init__(self, bits: np.ndarray, shift: int):
        self.bits, self.shift = bits, shift

    def repeated(self, anchor: np.ndarray) -> np.ndarray:
        on = np.ones(len(anchor), bool)
        for row, cells in zip(self.bits, _cells(anchor), strict=True):
            cells = cells >> self.shift
            on &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1) > 0
        return on


def sketch(docs: DataFrame) -> Sketch:
    """The merged count-min sketch of all documents' anchors."""
    import pyarrow as pa

    def counted(raw, memory):
        for a, b in slices(raw, SLICE):
            h, ends = hashed_words(raw[a:b], memory)
            g, text, _, _ = anchors(h, ends)
            once = np.unique(g ^ mix(text.astype(np.uint64) + np.uint64(9)), return_index=True)[1]
            yield g[once]

    def run(batches):
        from pyspark import TaskContext

        memory, held = WordHash(), []
        for rb in batches:
            held += counted(rb.column(0).to_pylist(), memory)
        memory.clear()
        part, block, data = TaskContext.get().partitionId(), [], []
        found = np.concatenate([*held, np.zeros(0, np.uint64)])
        for row, cells in enumerate(_cells(found)):
            cells.sort()
            cells = cells[np.concatenate([np.ones(min(len(cells), 2), bool), cells[2:] != cells[:-2]])]
            cuts = np.searchsorted(cells, np.arange(BLOCKS + 1) * ((1 << GRID) // BLOCKS))
            for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                block.append(row * BLOCKS + i)
                data.append(_sparse(cells[x:y] - i * ((1 << GRID) // BLOCKS)))
        count = np.zeros(len(block), np.int64)
        count[0] = len(found)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(block), pa.int32()), pa.array(block, pa.int32()), pa.array(count), pa.array(data, pa.binary())], names=["part", "block", "n", "data"])
        free_memory()

    parts = materialize(docs.select(text_bytes(docs).alias("_text")).where(docs["doc_id"].isNotNull()).mapInArrow(run, "part int, block int, n long, data binary"))
    count = parts.agg(F.sum("n")).first()[0] or 0
    shift = GRID - min(GRID, max(LEAST_GRID, int(4 * count).bit_length()))

    def merge(blobs):
        once = twice = None
        for x in blobs:
            one, two = _bits(x, shift)
            once, twice = (one, two) if once is None else (once | one, twice | two | (once & one))
        return b"d" + zlib.compress(np.concatenate([once, twice]).tobytes(), 1)

    size = 1 << (GRID - shift - 3)
    bits = np.zeros((2, size), np.uint8)
    for r in merge_blocks(parts.drop("n"), merge).toLocalIterator():  # 2 * BLOCKS rows
        twice = _bits(r.data, shift)[1]
        at = r.block % BLOCKS * (size // BLOCKS)
        bits[r.block // BLOCKS, at : at + len(twice)] = twice
    discard(parts)
    return Sketch(bits, shift)


def _occurrences(docs: DataFrame, counts: Sketch) -> DataFrame:
    """A row for each run of windows whose anchor is estimated to be in several
    documents: anchor, ctx (16 bytes: all its words), doc_id, rk, first, n, wins."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # at most 64 MB

    def found(rb, many, memory):
        raw = rb.column(2).to_pylist()
        for a, b in slices(raw, SLICE):
            h, ends = hashed_words(raw[a:b], memory)
            g, text, start, n = anchors(h, ends)
            on = many.repeated(g)
            g, text, start, n = g[on], text[on], start[on], n[on]
            wins = window_hashes(h, start, n) if len(g) else np.zeros(0, np.int64)
            of = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ctx = [hashlib.blake2b(wins[i:j].tobytes() + int(x).to_bytes(8, "little"), digest_size=16).digest() for i, j, x in zip(of[:-1], of[1:], g, strict=True)]
            at = pa.array(text + a, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ctx, pa.binary()), rb.column(0).take(at), rb.column(1).take(at), pa.array((start - ends[text]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(of), pa.array(wins))], names=["anchor", "ctx", "doc_id", "rk", "first", "n", "wins"])

    def run(batches):
        many, memory = shared.value, WordHash()
        for rb in batches:
            yield from found(rb, many, memory)
        memory.clear()
        free_memory()

    text = text_bytes(docs)
    rows = docs.where(docs["doc_id"].isNotNull()).select("doc_id", F.xxhash64(text).alias("rk"), text.alias("_text"))
    return rows.mapInArrow(run, f"anchor long, ctx binary, doc_id {kind}, rk long, first int, n int, wins array<long>")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, rk (hash of the text), runs array<struct<first, n>>: the windows of
    each document that also start in one with a smaller id."""
    spark = docs.sparkSession
    prepare(spark)
    shrink_heaps(spark)
    occ = materialize(_occurrences(docs, sketch(docs)))
    shrink_heaps(spark)
    ctx = materialize(occ.groupBy("ctx").agg(F.first("anchor").alias("anchor"), F.first("wins").alias("wins"), F.min("doc_id").cast("long").alias("least"), F.max("doc_id").cast("long").alias("most")).withColumn("tail", F.expr("substring(ctx, 1, 8)")))
    places = materialize(occ.select("ctx", "doc_id", "rk", "first", "n"))
    discard(occ)
    several = ctx.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    # A common anchor with many contexts is met by each of its salts.
    several = several.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = ctx.withColumn("salt", F.expr(f"pmod(hash(ctx), {SALTS})"))
    shrink_heaps(spark)
    # An anchor and half of a context's hash name it in the rows of single windows.
    shared = materialize(salted.join(several, ["anchor", "salt"], "left_semi").select("anchor", "tail", "least", "wins"))
    each = shared.select("anchor", "tail", "least", F.posexplode("wins").alias("i", "win"))
    first = each.groupBy("anchor", "win").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("anchor", "win", "first")
    # The windows that an earlier document has in another context.
    early = each.join(first, ["anchor", "win"]).where("first < least").groupBy("anchor", "tail").agg(F.array_sort(F.collect_list(F.struct("i", F.col("first").alias("least")))).alias("each"))
    known = ctx.select("ctx", "anchor", "tail", "least", "most").join(early, ["anchor", "tail"], "left").where("most > least or each is not null")
    shrink_heaps(spark)
    known = materialize(known.select("ctx", "least", "each"))
    discard(shared, ctx)
    shrink_heaps(spark)
    hit = places.join(known, "ctx")
    whole = F.array(F.struct(F.col("first").alias("first"), F.col("n").alias("n")))
    ones = F.transform(F.filter("each", lambda x: x["least"] < F.col("doc_id")), lambda x: F.struct((F.col("first") + x["i"]).alias("first"), F.lit(1).alias("n")))
    runs = hit.select("doc_id", "rk", F.when(F.col("doc_id") > F.col("least"), whole).otherwise(ones).alias("r")).where("size(r) > 0")
    return runs.groupBy("doc_id", "rk").agg(F.flatten(F.collect_set("r")).alias("runs"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the text that is left,
    words joined by one blank)."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = repeated_windows(docs).select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), "runs")
    text = text_bytes(docs)
    rows = docs.select("doc_id", text.alias("_text"), F.xxhash64(text).alias("rk"))
    rows = rows.join(runs, (rows["doc_id"] == runs["_id"]) & (rows["rk"] == runs["_rk"]), "left").select("doc_id", "_text", F.col("runs.first").alias("first"), F.col("runs.n").alias("n"))

    def run(batches):
        for rb in batches:
            words, removed, kept = [], [], []
            for t, first, n in zip(*(rb.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                w = t.split()
                words.append(len(w))
                if first:
                    delta = np.zeros(len(w) + 1, np.int64)
                    a = np.array(first)
                    np.add.at(delta, a, 1)
                    np.add.at(delta, a + np.array(n) + WINDOW - 1, -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    removed.append(int(gone.sum()))
                    w = [w[i] for i in np.flatnonzero(~gone)]
                else:
                    removed.append(0)
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])
        free_memory()

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op6(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
