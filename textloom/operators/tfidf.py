"""TF-IDF weights, query scores and cosine similarity of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_of, tfidf_tokens
from ..storage import stored
from .counting import Best, document_counts, document_frequencies, frugal, own_counts, slices


def _kept(docs: DataFrame) -> DataFrame:
    """Empty texts are no documents; texts emptied by stop words are."""
    return docs.where(F.length("text") > 0)


def weights(docs: DataFrame, tokens=tfidf_tokens, binary: bool = False, domain: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, term, tf, idf, w = count / document length * ln(N / df).

    binary: tf is 1.  domain: terms whose idf is set to 1.  A document's terms are
    counted where it is read; its rows are shuffled once, by term, to the frequencies.
    The frequencies are the side that is hashed, so the rows are not sorted."""
    kept = _kept(docs)
    tf = document_counts(kept, tokens(F.col("text")))
    df = document_frequencies(kept, tokens(F.col("text")))
    n = kept.agg(F.count("*").alias("n_docs"))
    idf = F.log(F.col("n_docs") / F.col("df"))
    df = df.crossJoin(F.broadcast(n)).select("term", (F.when(F.col("term").isin(*domain), 1.0).otherwise(idf) if domain else idf).alias("idf"))  # one row
    share = F.lit(1.0) if binary else F.col("cnt") / F.col("n")
    return tf.join(df.hint("shuffle_hash"), "term").select("doc_id", "term", share.alias("tf"), "idf", (share * F.col("idf")).alias("w"))


def norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def query_scores(docs: DataFrame, query: str, multiset: bool = False, tokens=tfidf_tokens) -> DataFrame:
    """doc_id, score: the sum of the weights of the query's terms.  As a set, each
    term counts once and only scores above 1e-9 are given; as a multiset, repeats
    count again and every document is given.

    Only the query's terms are counted, in place; N and df are one row."""
    spark = docs.sparkSession
    words = spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t
    kept = _kept(docs)
    if not words:
        return kept.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(multiset))
    times = {w: words.count(w) if multiset else 1 for w in words}
    own = kept.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.filter("t", lambda x: x.isin(*times)).alias("own"))
    own = own.select("doc_id", "n", *[count_of(F.col("own"), w).alias(f"c_{i}") for i, w in enumerate(times)])
    dfs = own.agg(F.count("*").alias("n_docs"), *[F.count_if(F.col(f"c_{i}") > 0).alias(f"df_{i}") for i in range(len(times))])
    term = lambda i, k: F.when(F.col(f"c_{i}") > 0, k * F.col(f"c_{i}") / F.col("n") * F.log(F.col("n_docs") / F.col(f"df_{i}"))).otherwise(0.0)
    score = sum((term(i, k) for i, k in enumerate(times.values())), F.lit(0.0))
    out = own.crossJoin(F.broadcast(dfs)).select("doc_id", score.alias("score"))  # one row
    return out if multiset else out.where("score > 1e-9")


def unit_vectors(weights: DataFrame) -> DataFrame:
    """doc_id, terms, values: each document's vector at length one, terms in
    order; documents whose weights are all zero have none."""
    import pyarrow as pa

    pairs = weights.where("w != 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("v"))
    rows = pairs.select("doc_id", F.col("v.term").alias("terms"), F.col("v.w").alias("values"))

    # As a lambda, the norm would be worked out again for each term.
    def run(batches):
        for rb in batches:
            if rb.num_rows:
                lists = rb.column(2)
                w, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                norm = np.sqrt(np.add.reduceat(w * w, np.cumsum(sizes) - sizes))  # no list is empty
                unit = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(w / np.repeat(norm, sizes)))
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), unit], names=["doc_id", "terms", "values"])

    return rows.mapInArrow(frugal(run), rows.schema)


def top_scores(docs: DataFrame, query: str, k: int = 10, multiset: bool = False, tokens=tfidf_tokens) -> DataFrame:
    """rank, doc_id, score of the first k documents by falling score, ties by doc_id."""
    best = query_scores(docs, query, multiset, tokens).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")  # k rows


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, numbers: int = 1 << 21) -> DataFrame:
    """query_id, doc_id, similarity, rank: the k most similar other documents of
    each query(doc_id), with similarity above 0, ties by doc_id.

    The vectors are written once.  The queries are a stated set, taken in blocks of at
    most so many weights, or one query; a block is one pass over the vectors, and a task
    gives its best k per query, so what is shuffled does not grow with the documents."""
    spark = vectors.sparkSession
    vectors = stored(vectors)
    out = None
    # Written by all cores; the driver then reads few parts, one after another.
    asked = stored(vectors.join(queries.select("doc_id"), "doc_id", "left_semi"))
    for held in _blocks(asked.coalesce(8), numbers):
        part = _neighbours(vectors, held, k)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, doc_id long, similarity double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, numbers: int):
    held, n = [], 0
    for r in rows.toLocalIterator(prefetchPartitions=True):
        if held and n + len(r.terms) > numbers:
            yield held
            held, n = [], 0
        held.append((r.doc_id, r.terms, r["values"]))
        n += len(r.terms)
    if held:
        yield held


def _neighbours(vectors: DataFrame, held: list, k: int, chunk_cells: int = 1 << 20, common: float = 0.05) -> DataFrame:
    """Terms that `common` of the block's queries have are multiplied as dense columns;
    of the others only the queries that have them are met."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n_queries = len(held)
    flat = pa.array([t for _, terms, _ in held for t in terms], pa.string()).dictionary_encode()
    at, terms = flat.indices.to_numpy(), flat.dictionary
    query = np.repeat(np.arange(n_queries), [len(t) for _, t, _ in held])
    value = np.concatenate([np.asarray(v, np.float64) for _, _, v in held])
    have = np.bincount(at, minlength=len(terms))
    often = have > common * n_queries
    place = np.where(often, np.cumsum(often) - 1, -1)  # columns of the dense part
    dense = np.zeros((int(often.sum()), n_queries))
    dense[place[at[often[at]]], query[often[at]]] = value[often[at]]
    rare = np.flatnonzero(~often[at])
    rare = rare[np.argsort(at[rare], kind="stable")]
    have[often] = 0
    starts = np.cumsum(have) - have
    ids = np.array([i for i, _, _ in held])
    shared = vectors.sparkSession.sparkContext.broadcast((terms, place, dense, have, starts, query[rare].astype(np.int32), value[rare], ids))  # one block of queries

    def run(batches):
        terms, place, dense, have, starts, query, value, ids = shared.value
        n = len(ids)
        best = Best(n, k)
        for rb in batches:
            docs = rb.column(0).to_numpy()
            offsets = rb.column(1).offsets.to_numpy()
            ends = offsets - offsets[0]
            col = pc.fill_null(pc.index_in(rb.column(1).flatten(), value_set=terms), -1).to_numpy()
            val = rb.column(2).flatten().to_numpy()
            meets = np.concatenate([[0], np.cumsum(np.where(col >= 0, have[col], 0))])[ends]
            a = 0
            while a < len(docs):
                b = min(len(docs), a + max(1, chunk_cells // n))
                b = max(a + 1, min(b, int(np.searchsorted(meets, meets[a] + chunk_cells, "right")) - 1))
                own, v = col[ends[a] : ends[b]], val[ends[a] : ends[b]]
                row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                row, own, v = row[own >= 0], own[own >= 0], v[own >= 0]
                x = np.zeros((b - a, len(dense)))
                d = place[own] >= 0
                x[row[d], place[own[d]]] = v[d]
                sims = x @ dense
                row, own, v = row[~d], own[~d], v[~d]
                each = have[own]
                total = int(each.sum())
                if total:
                    one = np.arange(total) + np.repeat(starts[own] - np.cumsum(each) + each, each)
                    sims += np.bincount(np.repeat(row * n, each) + query[one], np.repeat(v, each) * value[one], (b - a) * n).reshape(b - a, n)
                sims = np.minimum(np.round(sims, 12), 1.0)  # equal vectors tie, whatever their chunk
                sims[docs[a:b, None] == ids[None, :]] = 0
                best.offer(docs[a:b], sims)
                a = b
        best.judge()
        q, of, sim = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(of), pa.array(sim)], names=["query_id", "doc_id", "similarity"])

    return vectors.select("doc_id", "terms", "values").mapInArrow(frugal(run), "query_id long, doc_id long, similarity double")


def unit_rows(weights: DataFrame) -> DataFrame:
    """doc_id, term, idf, v: the weights of each document at length one."""
    return weights.where("w != 0").join(norms(weights), "doc_id").select("doc_id", "term", "idf", (F.col("w") / F.col("norm")).alias("v"))


def _dots(pairs: DataFrame, unit: DataFrame) -> DataFrame:
    left = unit.select(F.col("doc_id").alias("d1"), "term", F.col("v").alias("v1"))
    right = unit.select(F.col("doc_id").alias("d2"), "term", F.col("v").alias("v2"))
    return pairs.join(left, "d1").join(right, ["d2", "term"]).groupBy("d1", "d2").agg(F.least(F.sum(F.col("v1") * F.col("v2")), F.lit(1.0)).alias("similarity"))


def similar_pairs(weights: DataFrame, least: float) -> DataFrame:
    """d1, d2, similarity (d1 < d2) of all pairs of documents at `least` or more.

    Prefix filter: with terms in one global order (rarest first), a vector's suffix
    of length below `least` cannot make a pair on its own, so two documents of such
    a pair share a term of both prefixes.  Prefixes hold the rare terms, so the join
    meets few pairs; each candidate is verified once with its whole vectors."""
    return _pairs_at(unit_rows(weights), least)


def _pairs_at(unit: DataFrame, least: float) -> DataFrame:
    rest = Window.partitionBy("doc_id").orderBy("idf", F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = unit.withColumn("rest", F.sqrt(F.sum(F.col("v") * F.col("v")).over(rest))).where(F.col("rest") >= least - 1e-9).select("doc_id", "term")
    a, b = prefix.withColumnRenamed("doc_id", "d1"), prefix.withColumnRenamed("doc_id", "d2")
    pairs = a.join(b, "term").where("d1 < d2").select("d1", "d2").distinct()
    return _dots(pairs, unit).where(F.col("similarity") >= least)


def _everywhere(kept: DataFrame, tokens) -> list[str]:
    """The terms that every document has: no more than any one document has.  Some
    documents nearly always show that there are none; only else all are looked at."""
    import pyarrow as pa

    def run(batches):
        for rb in batches:
            for part in slices(rb):
                _, code, _, words, sizes = own_counts(part)
                full = np.bincount(code, minlength=len(words)) == len(sizes)
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(full)), pa.array(np.full(full.sum(), len(sizes)))], names=["term", "df"])

    def shared(docs):
        rows = docs.select("doc_id", tokens(F.col("text")).alias("t"))
        df = rows.mapInArrow(frugal(run), "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        n = docs.agg(F.count("*").alias("n"))
        return [r.term for r in df.join(F.broadcast(n), F.col("df") == F.col("n")).select("term").collect()]  # one row

    return shared(kept) if shared(stored(kept.select("doc_id", "text").limit(100))) else []


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit numbers spread by multiplications and shifts."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _proportional(docs: DataFrame, tokens) -> tuple | None:
    """The first two documents with proportional counts of the terms that not every
    document has.  Counts are taken relative to the document's least, which is the same
    correctly rounded number for all of a class and no other, so the class is exact but
    for its key, a sum of 128 bits over the terms.  It is made where the document is."""
    import pandas as pd
    import pyarrow as pa

    kept = _kept(docs)
    every = _everywhere(kept, tokens)

    def run(batches):
        out = set(every)
        for rb in batches:
            for part in slices(rb):
                row, code, counts, words, sizes = own_counts(part)
                names = words.to_numpy(zero_copy_only=False)
                if out:
                    stay = ~np.array([w in out for w in names], bool)[code]
                    row, code, counts = row[stay], code[stay], counts[stay]
                if not len(row):
                    continue
                first = np.flatnonzero(np.diff(row, prepend=-1))
                rows = row[first]
                least = np.minimum.reduceat(counts, first)
                ratio = (counts / np.repeat(least, np.diff(first, append=len(row)))).view(np.uint64)
                keys = []
                for salt in ("0123456789123456", "textloom.classes"):
                    h = pd.util.hash_array(names, hash_key=salt, categorize=False)[code]
                    keys.append(np.add.reduceat(_mixed(h + _mixed(ratio, 1), 2), first).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *map(pa.array, keys)], names=["doc_id", "a", "b"])

    classes = stored(kept.select("doc_id", tokens(F.col("text")).alias("t")).mapInArrow(frugal(run), "doc_id long, a long, b long"))
    first = classes.groupBy("a", "b").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("last")).where("d1 < last").orderBy("d1").limit(1).collect()
    if not first:
        return None
    f = first[0]
    second = classes.where((F.col("a") == f.a) & (F.col("b") == f.b) & (F.col("doc_id") > f.d1)).agg(F.min("doc_id")).first()[0]
    return f.d1, second


def most_similar_pair(docs: DataFrame, tokens=tfidf_tokens) -> DataFrame:
    """d1, d2, similarity of the most similar pair (ties: the smallest ids).

    Documents with proportional term counts have similarity 1: where there are such,
    the answer is the first two of a class, found by one aggregation.  Otherwise pairs
    that share a rare term give a first threshold, and an exact join at it has the best
    pair.  Where no two documents share a term, the first two have similarity 0; with
    fewer than two documents there is no row."""
    schema = "d1 long, d2 long, similarity double"
    spark = docs.sparkSession
    twins = _proportional(docs, tokens)
    if twins:
        return spark.createDataFrame([(*twins, 1.0)], schema)
    unit = stored(unit_rows(weights(docs, tokens)))
    order = lambda pairs: pairs.orderBy(F.desc("similarity"), "d1", "d2").limit(1).collect()
    rare = unit.groupBy("term").agg(F.count("*").alias("df")).where("df between 2 and 8").select("term")
    some = unit.join(rare, "term").select("doc_id", "term")
    a, b = some.withColumnRenamed("doc_id", "d1"), some.withColumnRenamed("doc_id", "d2")
    seen = order(_dots(a.join(b, "term").where("d1 < d2").select("d1", "d2").distinct(), unit))
    found = []
    for least in [seen[0].similarity - 1e-9] if seen else [0.5, 0.2, 0.05, 0.0]:
        found = order(_pairs_at(unit, max(least, 0.0)))
        if found:
            break
    if found and found[0].similarity > 0:
        return spark.createDataFrame([tuple(found[0])], schema)
    two = [r.doc_id for r in _kept(docs).select("doc_id").orderBy("doc_id").limit(2).collect()]
    return spark.createDataFrame([(*two, 0.0)] if len(two) == 2 else [], schema)
