"""Inverted index and its posting lists: statistics, inverse document frequency,
d-gaps, code sizes and membership.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import streams
from ..functions.codes import ENCODERS, encode_list, fibonacci_length, gamma_length, gaps
from ..functions.text import index_tokens
from ..storage import stored
from .counting import frugal, merged, posting_slices


def store(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the index as a table of files by a hash of the term: a query then reads
    only its terms' files.  Built once, read by boolean.find_stored()."""
    rows = postings.withColumn("buckets", F.lit(buckets)).withColumn("bucket", F.expr(f"pmod(hash(term), {buckets})"))
    rows.repartition("bucket").sortWithinPartitions("term", "doc_id").write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path)


def load(spark, path: str, words: list[str] | None = None) -> DataFrame:
    """The stored index, or only the postings of some words."""
    rows = spark.read.schema("term string, doc_id long, tf long, buckets int, bucket int").parquet(path)
    if words is not None:
        buckets = rows.select("buckets").first()
        n = buckets[0] if buckets else 1
        own = sorted({r[0] for r in spark.createDataFrame([(w,) for w in words], "term string").select(F.expr(f"pmod(hash(term), {n})")).collect()})
        rows = rows.where(F.col("bucket").isin(*own) & F.col("term").isin(*words))
    return rows.select("term", "doc_id", "tf")


def postings(docs: DataFrame, tokens=index_tokens) -> DataFrame:
    """term, doc_id, tf.  A document is whole in one task, so nearly all counting
    is done before the shuffle."""
    return docs.select("doc_id", F.explode(tokens(docs["text"])).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def statistics(postings: DataFrame) -> DataFrame:
    per_term = postings.groupBy("term").agg(F.count("*").alias("df"))
    return per_term.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.avg("df").alias("mean_list"))


def document_frequencies(docs: DataFrame, tokens=index_tokens) -> DataFrame:
    """term, df, with one row per document and term before the shuffle."""
    return docs.select(F.explode(F.array_distinct(tokens(docs["text"]))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf_log10(docs: DataFrame, tokens=index_tokens) -> DataFrame:
    """term, df, idf = log10(N / df); N counts all documents."""
    n = docs.agg(F.count("*").alias("n_docs"))
    return document_frequencies(docs, tokens).crossJoin(F.broadcast(n)).select("term", "df", F.log10(F.col("n_docs") / F.col("df")).alias("idf"))  # one row


def gap_rows(postings: DataFrame, shift: int = 1, segment: int = 1 << 20) -> DataFrame:
    """term, doc_id, gap: ids raised by `shift` (codes need 1 and more), as
    differences within a term.

    A term that a third of all documents have must not land in one task, so lists
    are cut into segments of the id range; each segment starts from the last id of
    the one before it, which a join on the small table of segment ends brings."""
    rows = postings.select("term", (F.col("doc_id") + shift).alias("doc_id")).withColumn("seg", F.expr(f"doc_id div {segment}"))
    ends = rows.groupBy("term", "seg").agg(F.max("doc_id").alias("last"))
    before = F.lag("last", 1, 0).over(Window.partitionBy("term").orderBy("seg"))
    starts = ends.select("term", "seg", before.alias("before"))
    inside = F.lag("doc_id").over(Window.partitionBy("term", "seg").orderBy("doc_id"))
    own = rows.withColumn("prev", inside)
    return own.join(starts, ["term", "seg"]).select("term", "doc_id", (F.col("doc_id") - F.coalesce("prev", "before")).alias("gap"))


def _differences(ids: np.ndarray, offsets: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The gaps of all lists, each from what stands before it."""
    out = np.diff(ids, prepend=0)
    some = np.diff(offsets) > 0
    at = offsets[:-1][some]
    out[at] = ids[at] - before[some]
    return out


def _gaps_of(docs: DataFrame, finish, schema: str, tokens=index_tokens, segment: int = 1 << 20) -> DataFrame:
    """finish(terms, before, ids, offsets, gaps) over the lists of the documents' terms.

    The texts are read once: a list goes out as one row of each slice, written and read
    again for the ends of segments, where the ids have more than one segment."""
    slices = stored(posting_slices(docs, tokens(docs["text"]), segment))
    starts = None
    if slices.agg(F.min("seg") != F.max("seg")).first()[0]:
        ends = slices.groupBy("term", "seg").agg(F.max(F.element_at("ids", -1)).alias("last"))
        starts = ends.select("term", "seg", F.lag("last", 1, 0).over(Window.partitionBy("term").orderBy("seg")).alias("before"))

    def run(terms, seg, before, ids, offsets):
        return finish(terms, before, ids, offsets, _differences(ids, offsets, before))

    return merged(slices, run, schema, starts)


def document_gaps(docs: DataFrame, tokens=index_tokens, segment: int = 1 << 20) -> DataFrame:
    """gap_rows() of the documents' postings."""
    import pyarrow as pa

    def finish(terms, before, ids, offsets, gap):
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(np.repeat(np.arange(len(terms)), np.diff(offsets)))), pa.array(ids), pa.array(gap)], names=["term", "doc_id", "gap"])

    return _gaps_of(docs, finish, "term string, doc_id long, gap long", tokens, segment)


def gap_counts(docs: DataFrame, tokens=index_tokens, segment: int = 1 << 20) -> DataFrame:
    """gap, cnt over all lists."""
    import pyarrow as pa

    def finish(terms, before, ids, offsets, gap):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(gap, return_counts=True)], names=["gap", "cnt"])

    return _gaps_of(docs, finish, "gap long, cnt long", tokens, segment).groupBy("gap").agg(F.sum("cnt").alias("cnt"))


def document_code_sizes(docs: DataFrame, tokens=index_tokens, segment: int = 1 << 20) -> DataFrame:
    """code_sizes() of the documents' gaps: sums of each batch of lists."""
    import pyarrow as pa

    tens = 10 ** np.arange(1, 19, dtype=np.int64)

    def finish(terms, before, ids, offsets, gap):
        # Commas stand between the ids of a term: one less than there are ids, whose first has nothing before it.
        chars = int((np.searchsorted(tens, np.abs(ids), "right") + 1 + (ids < 0)).sum()) + len(ids) - int((before == 0).sum())
        sums = [8 * chars, *(int(streams.lengths(gap, c).sum()) for c in ENCODERS)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=["text_bits", *(f"{c}_bits" for c in ENCODERS)])

    names = ["text_bits", *(f"{c}_bits" for c in ENCODERS)]
    rows = _gaps_of(docs, finish, ", ".join(f"{n} long" for n in names), tokens, segment)
    total = rows.agg(*[F.sum(n).alias(n) for n in names])
    return total.select("*", *[(F.col(f"{c}_bits") / F.col("text_bits")).alias(f"{c}_ratio") for c in ENCODERS])


def document_segments(docs: DataFrame, segment: int = 1 << 12, tokens=index_tokens) -> DataFrame:
    """list_segments() of the documents' postings."""
    import pyarrow as pa

    def finish(terms, seg, before, ids, offsets):
        yield pa.RecordBatch.from_arrays([terms, pa.array(seg), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], names=["term", "seg", "ids"])

    return merged(posting_slices(docs, tokens(docs["text"]), segment), finish, "term string, seg long, ids array<long>")


def posting_lists(postings: DataFrame, shift: int = 1) -> DataFrame:
    """term, ids: the sorted list in one row, for lists that fit one."""
    return postings.groupBy("term").agg(F.array_sort(F.collect_set(F.col("doc_id") + shift)).alias("ids"))


def list_segments(postings: DataFrame, shift: int = 1, segment: int = 1 << 12) -> DataFrame:
    """term, seg, ids: the sorted lists, cut where the ids pass multiples of `segment`,
    so that no row has more ids, whatever the term."""
    rows = postings.select("term", (F.col("doc_id") + shift).alias("id"))
    return rows.groupBy("term", F.expr(f"id div {segment}").alias("seg")).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def encoded_lists(lists: DataFrame, code: str, segment: int | None = None) -> DataFrame:
    """The other columns of lists, and bits: the d-gaps of ids as one stream.  A
    segment's first gap is its first id, or, with `segment`, is counted from the place
    before the segment's start, so that no code is longer than a segment allows."""
    import pyarrow as pa

    keys = [c for c in lists.columns if c != "ids"]

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            ids, own = rb.column(len(keys)), rb.slice(0)
            sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            before = np.zeros(len(sizes), np.int64) if segment is None else own.column(keys.index("seg")).to_numpy() * segment - 1
            bits = streams.encode(_differences(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets, before), offsets, code)
            bits = pa.compute.if_else(ids.is_null(), pa.scalar(None, pa.string()), bits)
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(len(keys))), bits], names=[*keys, "bits"])

    kinds = ", ".join(f"`{c}` {lists.schema[c].dataType.simpleString()}" for c in keys)
    return lists.select(*keys, "ids").mapInArrow(frugal(run), f"{kinds}, bits string")


def decoded_lists(encoded: DataFrame, code: str, segment: int) -> DataFrame:
    """term, seg, gaps (the first one from 0) of streams made with `segment`."""
    import pyarrow as pa

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            gaps, counts, _ = streams.decode(rb.column(2), code)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            some = counts > 0
            gaps[offsets[:-1][some]] += rb.column(1).to_numpy()[some] * segment - 1
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(gaps))], names=["term", "seg", "gaps"])

    return encoded.select("term", "seg", "bits").mapInArrow(frugal(run), "term string, seg long, gaps array<long>")


def code_sizes(gap_rows: DataFrame) -> DataFrame:
    """Bits of all gaps in each code, of the lists as comma-joined text (8 a
    character), and the ratios."""
    # Lengths are worked out without the codes; the unary code of n has n bits.
    gap = F.col("gap")
    per_term = gap_rows.groupBy("term").agg((F.sum(F.length(F.col("doc_id").cast("string"))) + F.count("*") - 1).alias("chars"), F.sum("gap").alias("unary_bits"), F.sum(gamma_length(gap)).alias("gamma_bits"), F.sum(fibonacci_length(gap)).alias("fibonacci_bits"))
    total = per_term.agg((8 * F.sum("chars")).alias("text_bits"), *[F.sum(f"{c}_bits").alias(f"{c}_bits") for c in ENCODERS])
    return total.select("*", *[(F.col(f"{c}_bits") / F.col("text_bits")).alias(f"{c}_ratio") for c in ENCODERS])


def member(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(term, doc_id) with `found`."""
    hit = postings.select("term", "doc_id", F.lit(True).alias("hit")).distinct()
    return wanted.join(hit, ["term", "doc_id"], "left").select("term", "doc_id", F.coalesce("hit", F.lit(False)).alias("found"))


def _next_unary(bits: str, at: int) -> tuple[int, int]:
    end = bits.index("0", at)
    return end - at + 1, end + 1


def _next_gamma(bits: str, at: int) -> tuple[int, int]:
    size, at = _next_unary(bits, at)
    end = at + size - 1
    if end > len(bits):
        raise ValueError("cut short")
    return int("1" + bits[at:end], 2), end


def _next_fibonacci(bits: str, at: int) -> tuple[int, int]:
    end = bits.index("11", at)
    total, a, b = 0, 1, 2
    for c in bits[at : end + 1]:
        total += a * (c == "1")
        a, b = b, a + b
    return total, end + 2


DECODERS = {"unary": _next_unary, "gamma": _next_gamma, "fibonacci": _next_fibonacci}


def holds(bits: str | None, target: int, code: str) -> bool:
    """Whether the ids behind the encoded gaps have the target: decoded one by one
    up to the first id that is not below it; a broken stream has nothing."""
    read, at, have = DECODERS[code], 0, 0
    try:
        while bits and at < len(bits) and have < target:
            gap, at = read(bits, at)
            have += gap
    except ValueError:
        return False
    return bool(bits) and have == target


def member_compressed(encoded: DataFrame, wanted: DataFrame, code: str, segment: int | None = None) -> DataFrame:
    """wanted(term, target) with `found`, from encoded(term, bits), or, of lists in
    segments, from encoded(term, seg, bits): only the segment that may hold the target
    is decoded.  The targets of one list (or segment) meet it in one row."""
    @F.pandas_udf("array<boolean>")
    def check(bits: pd.Series, targets: pd.Series) -> pd.Series:
        import pyarrow as pa

        # Each stream is decoded once for all its targets; broken ones, up to the break.
        gaps, counts, _ = streams.decode(pa.array(bits, pa.string()), code)
        ends = np.cumsum(counts)
        out = []
        for ts, a, b in zip(targets, ends - counts, ends, strict=True):
            ids, ts = np.cumsum(gaps[a:b]), np.asarray(ts, np.int64)
            at = np.searchsorted(ids, ts)
            out.append((at < len(ids)) & (np.append(ids, 0)[at] == ts))
        return pd.Series(out, dtype=object)

    keys = ["term"] if segment is None else ["term", "seg"]
    rows = wanted.select("term", "target")
    if segment is not None:
        rows = rows.withColumn("seg", F.expr(f"target div {segment}"))
    # A list is copied once per bundle of targets, not once per target; bundles are bounded.
    bundles = rows.withColumn("bundle", F.pmod(F.xxhash64("target"), F.lit(16))).groupBy(*keys, "bundle").agg(F.collect_list("target").alias("targets"))
    judged = bundles.join(encoded, keys, "left").select("term", F.explode(F.arrays_zip("targets", check("bits", "targets").alias("found"))).alias("x"))
    return judged.select("term", F.col("x.targets").alias("target"), "x.found")


def lookup_speed(postings: DataFrame, repetitions: int = 100, codes: tuple[str, ...] = ("unary", "gamma", "fibonacci")) -> DataFrame:
    """list (short, medium, long), term, n, target, exists, method, found, seconds: the
    mean time of a lookup in the plain list and in each code.

    Three lists are looked into: one of 10 to 50 ids, one of 100 to 500 from the middle
    of all lists by length, and one of 1000 and more, the longest first (where there is
    none such: the shortest, the middle and the longest).  Targets are the first, middle
    and last id and one that is missing.  Three lists come to the driver."""
    import time
    from bisect import bisect_left

    postings = stored(postings.select("term", "doc_id"))
    sizes = stored(postings.groupBy("term").agg(F.countDistinct("doc_id").alias("n")))
    n_lists = sizes.count()
    pick = lambda cond, *order: sizes.where(cond).orderBy(*order).limit(1).collect()
    chosen = {"short": pick("n between 10 and 50", "n", "term") or pick("true", "n", "term")}
    if n_lists > 100:
        median = sizes.agg(F.percentile_approx("n", 0.5, 10_000)).first()[0]
        chosen["medium"] = pick(f"n >= {median} and n between 100 and 500", "n", "term") or pick(f"n >= {median}", "n", "term")
    if n_lists > 200:
        chosen["long"] = pick("n >= 1000", F.desc("n"), "term") or pick("true", F.desc("n"), "term")
    spark, rows = postings.sparkSession, []
    schema = "list string, term string, n long, target long, exists boolean, method string, found boolean, seconds double"
    for name, got in chosen.items():
        if not got:
            continue
        own = posting_lists(postings.where(F.col("term") == got[0].term))
        lists = own.select("ids", *[encode_list(gaps(F.col("ids")), c).alias(c) for c in codes]).first()
        ids = lists.ids
        missing = next(i for i in range(1, len(ids) + 2) if i == len(ids) + 1 or ids[i - 1] != i)
        for target in (ids[0], ids[len(ids) // 2], ids[-1], missing if missing <= ids[-1] else ids[-1] + 1):
            plain = lambda t=target: (i := bisect_left(ids, t)) < len(ids) and ids[i] == t
            for method, look in (("uncompressed", plain), *((c, lambda c=c, t=target: holds(lists[c], t, c)) for c in codes)):
                start = time.perf_counter()
                for _ in range(repetitions):
                    found = look()
                rows.append((name, got[0].term, len(ids), int(target), target in ids, method, bool(found), (time.perf_counter() - start) / repetitions))
    return spark.createDataFrame(rows, schema)
